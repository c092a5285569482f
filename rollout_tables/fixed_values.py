"""Fixed values.

Everything in this module must equal the values the original training
project uses, or rewards, prompts and token masks come out different.
Keep them here, in plain text and in their natural order.
"""

# --- fixed values: task categories (the six kinds; anything else scores 0.0) ---
CATEGORIES = [
    "FIND_NEXT_BEST_MOVE",
    "FIND_ADVANTAGED_PLAYER",
    "FIND_FINAL_SCORE",
    "MLM_ON_MOVES",
    "FIND_LAST_MOVE",
    "SORT_FENS",
]

# --- fixed values: prompt text ---
SYSTEM_PREFIX = "You are an expert chess assistant."
SYSTEM_TASK = " Your task is: "
SYSTEM_KIND = "\n\nThe move classification is: "
RESPOND = "Respond in a json"
RESPOND_FORMAT = "Respond in a json in the format "
SIDE_TO_MOVE = "Side to move: "

# response format per kind, in the order the prompt builder checks them
RESPONSE_FORMATS = {
    "FIND_NEXT_BEST_MOVE": '{"next best move": "<move>"}',
    "MLM_ON_MOVES": '{"missing moves": ["<move1>", "<move2>", ...]}',
    "FIND_ADVANTAGED_PLAYER": '{"Most advantaged": "<white/black/draw>"}',
    "FIND_FINAL_SCORE": '{"score": "<score>"}',
    "FIND_LAST_MOVE": '{"missing move": "<move>"}',
    "SORT_FENS": '{"sorted FENs": ["<FEN1>", "<FEN2>", ...]}',
}

# kinds whose RL prompt carries the "Side to move" line
SIDE_TO_MOVE_KINDS = [
    "FIND_NEXT_BEST_MOVE",
    "FIND_ADVANTAGED_PLAYER",
    "FIND_FINAL_SCORE",
    "FIND_LAST_MOVE",
]

# --- fixed values: completion parsing ---
JSON_OBJECT_PATTERN = r"\{[^{}]*\}"
UCI_MOVE_PATTERN = r"[a-h][1-8][a-h][1-8]"
MOVE_KEYS = ["next best move", "missing move", "move", "best move"]
THINK_OPEN = "<|im_start|>assistant\n<think>\n"
THINK_CLOSE = "\n</think>"
CHARS_PER_TOKEN = 4.0

# --- fixed values: chess ---
START_FEN = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"

# --- fixed values: reasoning penalty ---
PENALTY_FREE_TOKENS = 500
PENALTY_SCALE = 0.1
PENALTY_DECAY_TOKENS = 300

# --- fixed values: label masking ---
ASSISTANT_TOKEN_ID = 248045
NEWLINE_TOKEN_ID = 198
IGNORE_INDEX = -100
HEADER_SCAN_WIDTH = 9

# --- fixed values: chat formats ---
CHATML_OPEN = "<|im_start|>"
CHATML_CLOSE = "<|im_end|>\n"
CHATML_GENERATION = "<|im_start|>assistant\n"
LLAMA3_HEADER_OPEN = "<|start_header_id|>"
LLAMA3_HEADER_CLOSE = "<|end_header_id|>\n\n"
LLAMA3_EOT = "<|eot_id|>"

# --- fixed values: split ratios and seed ---
SPLIT_SEED = 42
SPLITS_3WAY = [("sft_train", 0.70), ("rl", 0.20), ("test", 0.10)]
SPLITS_4WAY = [("sft_train", 0.64), ("sft_val", 0.06), ("rl", 0.20), ("test", 0.10)]

# --- fixed values: category weights (declared in the RL config) ---
CATEGORY_WEIGHTS = [
    ("FIND_NEXT_BEST_MOVE", 1.0),
    ("FIND_ADVANTAGED_PLAYER", 1.0),
    ("FIND_FINAL_SCORE", 0.8),
    ("MLM_ON_MOVES", 1.0),
    ("FIND_LAST_MOVE", 1.0),
    ("SORT_FENS", 0.5),
]

# --- fixed values: RL run settings used by reports ---
LOGGING_STEPS = 10
MAX_NEW_TOKENS = 256
TARGET_TOKENS = (20, 60)
TARGET_REWARD_GAIN_PER_1000_STEPS = 0.1

# --- fixed values: reward rules ---
# tiers are (|cp| above, floor, factor): reward = max(floor, factor * s), first tier that applies;
# the last tier (None) applies to everything below
ADVANTAGE_EXPECTED_CP = 50           # cp > 50 white, cp < -50 black, else draw
ADVANTAGE_TIERS = [(200, 0.5, 1.0), (50, 0.2, 0.5), (25, 0.0, 0.3), (None, -0.1, 0.2)]
ADVANTAGE_WRONG_FLOOR = -0.5         # wrong label: max(-0.5, -|s|)
ADVANTAGE_DRAW_PARTIAL = -0.2        # the draw branch (unreachable as written)
FINAL_SCORE_EXPECTED_CP = 200        # cp > 200 "1-0", cp < -200 "0-1", else "1/2-1/2"
FINAL_SCORE_TIERS = [(400, 0.5, 1.0), (200, 0.3, 0.8), (100, 0.1, 0.5), (None, -0.1, 0.3)]
FINAL_SCORE_DRAW_PARTIAL = -0.15
FINAL_SCORE_WRONG_FLOOR = -0.5
SCORE_LABELS = ("1-0", "0-1", "1/2-1/2")
NEXT_MOVE_FAILURE = -0.1
PARSE_FAILURE = -1.0                 # JSON scalar/array, unreadable list, too few items
LIST_BASE, LIST_SPAN = 0.5, 0.5      # MLM and SORT_FENS: 0.5 + 0.5 * share
LAST_MOVE_BEST, LAST_MOVE_TOP, LAST_MOVE_NONE, LAST_MOVE_OTHER = 1.0, 0.5, -0.5, -0.25
TOP_N_MOVES = 5
SCORE_CLAMP_CP = 5000
TANH_SCALE_CP = 200.0
LINEAR_SCALE_CP = 500.0
MATE_OFFSET = 10000
