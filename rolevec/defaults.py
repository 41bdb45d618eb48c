"""Parameter defaults of the clustering method.

Fixed values: these equal the original method's settings and are kept as the
defaults of every public function (callers may override any of them).
"""

# Fixed values (original settings), in the order the method uses them.
TOP_K = 5                      # motions kept per level
LEVEL_SPAN = (2, 40)           # first and last level of a user's life
SCALE = 100.0                  # scaled counts lie in 0..SCALE
PAD_MOTION = "0"               # motion written into empty top-k slots
PAD_VALUE = 0.0
COLUMN_K = 5                   # clusters per column when scoring a column
COLUMN_MAX_ITER = 20           # iterations of the k-means column score
KEPT_PER_LEVEL = 5             # dimensions kept per level after scoring
FINAL_MAX_ITER = 100           # first clustering round
FINAL_SEED = 21
MIN_DIVISIBLE_SIZE = 0.01      # bisecting k-means
SECOND_ROUND_K = 2             # second clustering round (k-means only)
SECOND_ROUND_MAX_ITER = 100
SECOND_ROUND_SEED = 21
MODELS = ("km", "bkm")
RUN_STAMP_FORMAT = "MMdd-HHmm"  # run directory stamp
FIELD_SEP = ","                 # text vector formats
TOKEN_SEP = "@"                 # event token: a@motion@...@params
PARAM_SEP = ",,"                # params inside the last token part
