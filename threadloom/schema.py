"""Column layout shared by all operators.

messages(dataset, conv_id, pos, msg_id, author, ts_us, text)      key (dataset, conv_id, pos)
edges(dataset, conv_id, child, parent)                            child and parent are positions
pairs(dataset, conv_id, i, c, ...)                                c is a candidate parent of i
preds(algorithm, dataset, conv_id, child, parent)                 no row = predicted root
"""

#: A conversation is identified by these columns; every shuffle key starts with them.
CONV = ["dataset", "conv_id"]

#: Candidate window and size protocol (fixed values).
WINDOW = 100
MAX_MSGS = 1200
PATH_CAP = 2000

HOUR_US = 3_600_000_000
WEEK_US = 7 * 24 * HOUR_US
