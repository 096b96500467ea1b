"""Column layouts of the tables the operators read and write, and shared constants."""

# DDL strings, usable wherever Spark takes a schema.
FRAME_POINTS = ("session string, frame_ts double, id bigint, x double, y double, z double")
ANNOTATED_POINTS = (
    "session string, frame_ts double, id bigint, x double, y double, z double, classif int, labels int"
)
POSES = (
    "session string, t double, px double, py double, pz double,"
    " qx double, qy double, qz double, qw double"
)
MAP_POINTS = (
    "id bigint, x double, y double, z double, nx double, ny double, nz double,"
    " score double, count int"
)
FUTURE_CLOUD = ("session string, origin_ts double, x double, y double, t double, classif int")
FUTURE_GRID = (
    "session string, frame_ts double, t_idx int, px int, py int,"
    " still double, long_t double, short_t double"
)
CONFUSION = ("truth int, pred int, n bigint")

# Class codes of the annotation vocabulary.
UNCERTAIN, GROUND, STILL, LONG_T, SHORT_T = 0, 1, 2, 3, 4
CLASS_NAMES = {0: "uncertain", 1: "ground", 2: "still", 3: "longT", 4: "shortT"}
IGNORED_CLASSES = (UNCERTAIN,)

DEFAULT_SEED = 42
EPS = 1e-6
