"""Values that results depend on. Every operator takes them as arguments; these are the defaults."""

# Composition of the organs.
CARBON_FRUIT = 0.4857
CARBON_LEAF = 0.45
WATER_MESOCARP = 0.25
DRY_TO_FRESH = 1 / (1 - WATER_MESOCARP)

# Plot geometry and light.
SCENE_AREA_M2 = 73.52941176470588
M2_PER_HA = 10000
PAR_FRACTION = 0.48

# Calendar. Month 1 of the data becomes 1 + MONTH_OFFSET after planting.
MONTH_OFFSET = -18

# Emission of new organs.
FTSW_STRESS_THRESHOLD = 0.3
PRODUCTION_SPEED_INITIAL = 0.0111
PRODUCTION_SPEED_MATURE = 0.0074
AGE_MATURITY_DAYS = 2920

# Fruit number against age.
FRUIT_AGE_START_DAYS = 2379.0
FRUIT_AGE_END_DAYS = 6500.0
FRUIT_FRACTION_FIRST = 0.3
FRUIT_NUMBER_MATURE = 2000

# Carbon demand of a male inflorescence.
MALE_POTENTIAL_BIOMASS = 1000
MALE_THERMAL_TIME = 10530 + 1800
RESPIRATION_COST = 1.44

# Thermal times (degree days) and the event window of the inflorescence rules.
TT_FLOWERING = 6300.0
TT_HARVEST = 12150.0
DURATION_FLOWERING_MALE = 1800.0
DURATION_FRUIT_SETTING = 405.0
FRACTION_OLEOSYNTHESIS = 0.8
EVENT_RANK = 25
EVENT_AGE_START = 2190
EVENT_AGE_END = 2373

# Pruning scenarios.
RANK_PRUNING = 50
SCENARIO_RANKS = (25, 50, 5)
SCENARIO_DURATIONS_MONTHS = (6, 12)

# Scales of the output tables.
SCALES = ("Scene", "Plant", "Phytomer", "Leaf", "Internode", "Male", "Female", "Soil")

# Labels as stored in the tables.
UNDETERMINED = "undetermined"
OPENED = "Opened"
PRUNED = "Pruned"
HARVESTED = "Harvested"
ABORTED = "Aborted"
FLOWERING = "Flowering"
OLEOSYNTHESIS = "Oleosynthesis"
SENESCENT = "Scenescent"
PRUNED_IN_WINDOW = "Pruned during time window"
PRUNED_AT_RANK = "Pruned at rank"
PRUNED_AT_HARVEST = "Pruned at bunch harvest"
