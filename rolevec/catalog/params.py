"""Parameters of the registered queries on the supplied test tables.

The level span of the events adapter is 2..6 (30 days, six-day levels); the
other values are the method's defaults.
"""

EPOCH = "2024-01-01"
FIRST_LEVEL = 2
DAYS = 6
LO, HI = 2, 6
TOP = 5
COLUMN_K = 5
KEPT = 5
PAD = "0"
POSITIVE_EVERY = 10
EXPAND_MAP = {"click_0": 0, "view_1": 2, "error_0": 3, "purchase_1": 1}
EMB_K = 5
PAD_NAMED = "click_0"   # the real motion that takes the pad's name in two queries
PAD_TOP = 12            # wide enough for pads to follow it
CLUMPS = (0.0, 1000.0, 10000.0, 11000.0)  # where the separated points lie
HALF_GAP = 100.0
FIT_K = 6               # clusters of the fits on the event vectors
LLOYD_ROUNDS = 12
SWEEP_K = (3, 6)
SWEEP_ROUNDS = 10
RECORD_TOKENS = 2       # tokens of a record in the query that parts busy days
COST_PIECE = 16          # values of a piece in the wide form of the column cost, small enough for many pieces here
COST_FAN = 4
BROKEN_OF = 11           # level records are broken by the remainder of their role
RUNS = (("0102-0900", 3), ("0102-0905", TOP), ("0102-0900", 2))  # (run id, k): the first run is repeated
