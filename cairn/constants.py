"""Fixed values of the map model."""

# Log-odds of a hit and of a miss, and the range that they are clamped to.
HIT, MISS, LOW, HIGH = 0.85, -0.7, -2.0, 3.5
# A chunk is a cell of one metre, a leaf a 32nd of it; a super-chunk has 16 chunks a side.
DEPTH, LEAVES, SUPER = 5, 32, 16
# Layers, and the seconds after which what is dynamic expires.
STRUCTURE, FURNITURE, DYNAMIC, TTL = 0, 1, 2, 30
# Level of detail: distance up to which a depth is used; beyond all, depth 1.
BANDS = ((10.0, 5), (30.0, 4), (80.0, 3))
# What a node without observations holds: grey, and a signed distance that is none.
GREY, UNKNOWN = 128, 3.4028234663852886e38
# Most observations that a node counts.
MOST_OBSERVATIONS = 65535

# Size priors by class: id, label, width, height, depth in metres, variance, layer.
PRIORS = (
    (1, "person", 0.5, 1.7, 0.3, 0.3, DYNAMIC),
    (2, "bicycle", 0.5, 1.0, 1.8, 0.2, DYNAMIC),
    (3, "car", 1.8, 1.5, 4.5, 0.3, STRUCTURE),
    (4, "motorcycle", 0.8, 1.1, 2.2, 0.2, DYNAMIC),
    (5, "bus", 2.5, 3.2, 12.0, 0.3, STRUCTURE),
    (6, "truck", 2.5, 3.0, 8.0, 0.4, STRUCTURE),
    (7, "dog", 0.3, 0.5, 0.7, 0.4, DYNAMIC),
    (8, "cat", 0.2, 0.3, 0.4, 0.3, DYNAMIC),
    (9, "chair", 0.5, 0.9, 0.5, 0.2, FURNITURE),
    (10, "dining table", 1.2, 0.75, 0.8, 0.3, FURNITURE),
    (11, "couch", 2.0, 0.85, 0.9, 0.3, FURNITURE),
    (12, "bed", 1.6, 0.6, 2.0, 0.3, FURNITURE),
    (13, "potted plant", 0.4, 0.6, 0.4, 0.5, FURNITURE),
    (14, "tv", 1.0, 0.6, 0.1, 0.4, FURNITURE),
    (15, "door", 0.8, 2.0, 0.1, 0.15, STRUCTURE),
    (16, "window", 1.0, 1.2, 0.1, 0.3, STRUCTURE),
    (17, "wall", 3.0, 2.8, 0.2, 0.5, STRUCTURE),
    (18, "fire hydrant", 0.3, 0.7, 0.3, 0.1, STRUCTURE),
    (19, "stop sign", 0.6, 0.6, 0.05, 0.1, STRUCTURE),
    (20, "bench", 1.5, 0.8, 0.5, 0.2, FURNITURE),
    (21, "parking meter", 0.3, 1.2, 0.3, 0.1, STRUCTURE),
)

# Cameras: fx, fy, cx, cy, width, height, k1, k2, k3, p1, p2.
CAMERAS = {
    "phone_14": (1440.0, 1440.0, 960.0, 720.0, 1920, 1440, 0.0, 0.0, 0.0, 0.0, 0.0),
    "phone_14_pro": (2073.0, 2073.0, 1512.0, 1008.0, 3024, 2016, 0.0, 0.0, 0.0, 0.0, 0.0),
    "phone_13": (1552.0, 1552.0, 960.0, 540.0, 1920, 1080, 0.0, 0.0, 0.0, 0.0, 0.0),
    "robot_dog": (460.0, 460.0, 640.0, 360.0, 1280, 720, -0.25, 0.06, 0.0, 0.0, 0.0),
    "drone": (500.0, 500.0, 640.0, 360.0, 1280, 720, 0.0, 0.0, 0.0, 0.0, 0.0),
    "robot": (600.0, 600.0, 320.0, 240.0, 640, 480, 0.0, 0.0, 0.0, 0.0, 0.0),
}
# Devices: camera, mounting offset, IMU rate, video rate, frame skip, encoder, LiDAR, and the trust in IMU orientation,
# encoder position, visual odometry at most, and scan matching.
DEVICES = {
    "robot_dog": ("robot_dog", (0.15, 0.0, 0.10), 10.0, 30.0, 3, True, True, 0.85, 0.7, 0.4, 0.5),
    "drone": ("drone", (0.0, 0.0, -0.05), 100.0, 30.0, 3, False, False, 0.5, 0.0, 0.8, 0.0),
    "robot": ("robot", (0.1, 0.0, 0.15), 10.0, 30.0, 3, True, True, 0.7, 0.6, 0.5, 0.5),
}
