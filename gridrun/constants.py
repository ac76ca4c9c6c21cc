"""Fixed values. They must equal the published method for results to match."""

# Class dimension: id -> (name, red, green, blue).
CLASSES = {
    0: ("Background", 0, 0, 0),
    1: ("Road", 255, 0, 0),
    2: ("Bridge", 0, 0, 255),
    3: ("Built-Up Area", 255, 255, 0),
    4: ("Water Body", 0, 200, 255),
}
ROOFTOP_RGB = (255, 140, 0)
ROAD, BRIDGE, BUILTUP, WATER = 1, 2, 3, 4
N_CLASSES = 5

# Field-visit scoring.
ROAD_ACCESS_M = 50.0
WATER_PROXIMITY_M = 30.0
DEDUP_DISTANCE_M = 30.0
MIN_CLUSTER_PX = 200
MIN_REVIEW_ZONE_PX = 500
CONFIDENCE_THRESHOLD = 0.70
MAX_QUEUE_ITEMS = 10
SCORE_WEIGHTS = {
    "confidence_risk": 0.35,
    "isolation_risk": 0.30,
    "cluster_size": 0.20,
    "water_proximity": 0.10,
    "fragmentation_context": 0.05,
}
AVG_STRUCTURE_M2 = 80.0

# Logit handling.
DEFAULT_BIAS = [0.0, 1.5, 4.0, 0.0, 0.0]
ENSEMBLE_WEIGHTS = (0.65, 0.35)
RGB_MEAN = (0.485, 0.456, 0.406)
RGB_STD = (0.229, 0.224, 0.225)

# Cleaning thresholds.
WATER_GATE, BRIDGE_GATE = 0.35, 0.40
ROOFTOP_MIN_PX, ROOFTOP_MAX_PX, ROOFTOP_MAX_ASPECT, ROOFTOP_MIN_FILL = 100, 8000, 6.0, 0.40
