"""Class names, layer classes, thresholds and default settings.

These are inputs to the computations, kept together so that a deployment can
see and override them in one place.
"""

# Segmentation classes by id, roof types included.
CLASS_NAMES = [
    "background",
    "building",
    "road",
    "vegetation",
    "water",
    "other",
    "rcc_roof",
    "tin_roof",
    "tiled_roof",
]

# Number of segmentation classes a model emits.
NUM_CLASSES = 6

# Vector layer name to class id; other layers are ignored.
LAYER_CLASSES = {
    "Built_Up_Area_type": 1,
    "Road": 2,
    "Road_Centre_Line": 2,
    "Water_Body": 4,
    "Water_Body_Line": 4,
    "Waterbody_Point": 4,
    "Utility_Poly": 5,
    "Utility": 5,
    "Bridge": 5,
    "Railway": 5,
}

# Tiling and raster filter defaults.
TILE_SIZES = (512, 640)
STRIDE = 448
TILE_SIZE = 512
OVERLAP = 64
CROP_SIZE = 640
CROP_OVERLAP = 120
GLOBAL_VARIANCE_MIN = 12.0
LOCAL_VARIANCE_MIN = 6.0
LOCAL_WINDOW = 50
LUMA_VARIANCE_MIN = 100.0
VALID_SHARE_MIN = 0.2
STACKED_VARIANCE_MIN = 15.0

# Line and point buffers in metres, metres per degree.
LINE_BUFFER_M = 3.0
POINT_BUFFER_M = 5.0
METRES_PER_DEGREE = 111000.0

# Detection settings.
DETECTION_CONFIDENCE_MIN = 0.25
DETECTION_IOU_MAX = 0.45
DETECTION_MAX = 300
FEATURE_DETECTIONS = 10
REFINE_TOP_K = 5

# Fusion vector lengths (segmentation, detections, depth, mask).
SEG_DIM = 768
DET_DIM = FEATURE_DETECTIONS * 6 + 3
DEPTH_DIM = 3
MASK_DIM = 4

# Decision rules.
DEFAULT_ACCEPT = 0.5
DEFAULT_CLASS = 1
DEFAULT_CONFIDENCE = 0.5
OVERRIDE_CONFIDENCE = 0.8
MIN_MASK_PIXELS = 100
WATER_GREEN_RATIO = 1.05
WATER_TEXTURE_MAX = 400.0
VEGETATION_BLUE_RATIO = 1.1
VEGETATION_TEXTURE_MAX = 150.0
LOW_CONFIDENCE = 0.60
SHADOW_HEIGHT = 0.5
TALL_HEIGHT = 12.0
ACCEPT_MIN = 0.3
MASK_QUALITY_MIN = 0.3
MIN_POLYGON_AREA = 10.0
SIMPLIFY_TOLERANCE = 0.5
REGION_MIN_AREA = 30.0

# Metrics and dataset preparation.
MATCH_IOU_MIN = 0.5
PSEUDO_LABEL_MIN = 0.85
PSEUDO_MIN_PIXELS = 50
BOX_LABEL_MIN_AREA = 100
GT_TILE_MIN_SUM = 200
OVERSAMPLE_WEIGHT = 5
DICE_SMOOTH = 1e-6
FOCAL_GAMMA = 2.0
LOSS_ALPHA = 0.5
FOLDS = 5

# Identity transform of a tile without metadata.
IDENTITY_TRANSFORM = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]
DEFAULT_CRS = "EPSG:32643"
EXPORT_CRS = "EPSG:32644"

# Tags that name the producer of a mask or measurement.
SEG_TAG = "swin"
DET_TAG = "yolo"
DEPTH_TAG = "depth"
REFINED_TAG = "geosam"
REFINED_REGION_TAG = "geosam_region"

# Error texts of a tile's diagnostics.
LOAD_ERROR = "load_error: "
GATE_ERROR = "gatekeeper_rejected_low_variance"
