"""Fixed values and defaults. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

# Layout of keys and owners.
NUM_GROUPS = 128
NUM_OWNERS = 4

# Iterated copy.
CONVERGED_BELOW = 1  # entries changed in a round
MAX_ROUNDS = 10
MAX_NON_DECREASING = 3

# Longest stay in a live state, in seconds.
TIMEOUTS_S = {"INIT": 30, "PRE_COPY": 300, "AWAIT_BARRIER": 60, "FINALIZING": 60}

# Bytes of a counter value; the key's own length comes on top.
VALUE_BYTES = 8

# A table is broadcast only if its counted rows stay within this; beyond it every operator
# has a shuffled way to the same result.
BROADCAST_ROWS = 200_000

# Pieces of the sequence at which broadcast routing intervals are cut. With ``NUM_GROUPS`` groups they add at
# most NUM_GROUPS * INTERVAL_PIECES rows to the broadcast table.
INTERVAL_PIECES = 1024

# A key with more records than this is split by blocks of the sequence number.
HOT_ROWS = 20_000_000
BLOCK = 20_000_000

# Copies of a lookup row when a join on a skewed key has to be salted.
SALTS = 32

# Bytes of new files that a micro-batch takes at most (one file at least).
MICRO_BATCH_BYTES = 1 << 30
