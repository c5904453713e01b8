"""Default parameters and fixed texts."""

# Parameters and text formats that results depend on.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 10
EMBED_BATCH = 150
TOP_K = 3
HISTORY_TURNS = 5
CHUNK_FORMAT = "Passage: %s\nSource: Page %d from %s\n"
PARTS_FOLLOW_UP = "What compatible parts or components are needed?"
TOOLS_FOLLOW_UP = "What tools must be used?"
TABLE_RULE = "-----"
PATH_SCHEME = "dbfs:"

# Default wording of the prompts; every function that uses one takes another.
SYSTEM_TEMPLATE = (
    "Answer maintenance questions from the passages below only. "
    "If they do not hold the answer, say that you do not know.\n{context}"
)
REWRITE_INSTRUCTIONS = (
    "\nArrange the answer as tools, parts and numbered steps, followed by safety advice."
)
GUIDED_TEMPLATE = (
    "Help me to %s the part %s.\nTake into account what is known about these items:\n%s"
)

# Bounds behind size checks. Each one switches to another exact plan when passed.
BROADCAST_VECTOR_BYTES = 64 * 1024 * 1024
SEARCH_BLOCK_ROWS = 8_192
GRID_BYTES = 64 * 1024 * 1024
EMBED_BUCKETS = 64
BATCH_BYTES = 1024 * 1024 * 1024
