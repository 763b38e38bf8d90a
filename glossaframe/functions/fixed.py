"""Constants, word lists and formats that results depend on."""

# --- Fixed values: polarity words, tested in this order as plain substrings of the lower-cased text -----------
NEGATIVE_WORDS = ["negative", "complaint", "neg", "label_0", "吐槽", "负面", "差评"]
NEGATIVE_PHRASE_WORDS = ["negative", "complaint", "pain", "neg", "label_0", "吐槽", "负面", "差评"]
POSITIVE_WORDS = ["positive", "praise", "selling", "pos", "label_2", "label_1", "正面", "卖点", "好评"]

# --- Fixed values: enrichment -----------------------------------------------------------------------------
OUTPUT_TYPES = {"enum": "string", "string": "string", "number": "double", "boolean": "boolean"}
RERUN_MODES = ["reuse", "refresh", "no_write_cache"]
ROUTING_MODES = ["llm_only", "embed_then_llm", "embed_only"]
SKIP_LABEL = "__skip__"
PROMPT_PREVIEW_CHARS = 160
CONFIDENCE_THRESHOLD = 0.55
DRY_RUN_PREVIEW_ROWS = 10

# --- Fixed values: topics ---------------------------------------------------------------------------------
OUTLIER_TOPIC = -1
OUTLIER_LABEL = "other"
TOPIC_KEYWORDS = 8
KEYWORD_SEPARATOR = "、"
TOPIC_EXAMPLES = 3
TOPIC_EXAMPLE_CHARS = 100
TOPIC_LABEL_CHARS = 20
MIN_TOPIC_ROWS = 5

# --- Fixed values: discovery ------------------------------------------------------------------------------
PROPOSAL_TEXT_CHARS = 500
PHRASE_STYLES = ["canonical_issue", "canonical_praise", "canonical_scenario"]
EXAMPLE_ROWS = 5

# --- Fixed values: previews and search --------------------------------------------------------------------
PREVIEW_ROWS = 50
PREVIEW_CELL_CHARS = 200
LOAD_PREVIEW_ROWS = 3
SEARCH_MATCHES = 200
CACHE_GROUPS_SHOWN = 50

# --- Fixed values: transcripts ----------------------------------------------------------------------------
CHARS_PER_TOKEN = 3
SNIP_SHARE, SUMMARY_SHARE, COLLAPSE_SHARE = 0.50, 0.70, 0.90
SNIP_MIN_CHARS = 1500
SNIP_MAX_LINES = 6
SNIP_EDGE_LINES = 3
SNIP_MARKER_BEFORE, SNIP_MARKER_AFTER = "\n... (", " lines, snipped to save context) ...\n"
SUMMARY_OVER_MESSAGES, SUMMARY_KEEP = 10, 8
COLLAPSE_OVER_MESSAGES, COLLAPSE_KEEP = 4, 4
DIGEST_TURN_CHARS = 400
DIGEST_CHARS = 15000
KEY_PATHS, KEY_ERRORS, KEY_ERROR_CHARS = 20, 5, 150
PATH_PATTERN = r"[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]{1,5}"
PATHS_HEADING, ERRORS_HEADING, NO_KEY_INFO = "Files touched: ", "Errors seen: ", "(no extractable context)"
SUMMARY_HEADING = "[Context compressed - conversation summary]\n"
SUMMARY_REPLY = "Got it, I have the context from our earlier conversation."
COLLAPSE_HEADING = "[Hard context reset]\n"
COLLAPSE_REPLY = "Context restored. Continuing from where we left off."
LISTING_ROWS, LISTING_PREVIEW_CHARS = 20, 80
# every character or pair that ends a line
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
