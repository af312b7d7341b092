"""Values that define what the operators compute."""

# The words never used as label terms.
STOPWORDS = (
    "a an the and or but if then else of to in on at for with without from by is are was were be "
    "been being it its this that these those i you he she we they me my your our their as so not no "
    "do does did done have has had will would can could should may might must about into over under "
    "up down out just more most some any all each every than too very can't won't don't im ive"
).split()

# The characters that count as white space when lines are trimmed and texts are
# split into tokens (ASCII white space, the Unicode space separators, the line and paragraph
# separators and the byte order mark).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x20\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# How labels are written.
LABEL_SEPARATOR = " · "
EMPTY_LABEL = "misc"
LABEL_TERMS = 3

# Defaults of the map.
MIN_LINES = 3
KMEANS_SEED = 1337
KMEANS_MAX_ITER = 50
ELBOW_K_MIN = 2
ELBOW_K_MAX = 10
BOX_PAD = 48.0
PICK_RADIUS = 14.0
TURN_ANGLE = 2.399963
EXPORT_COLUMNS = ("line", "cluster", "label", "x", "y")
