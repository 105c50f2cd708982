"""Thresholds, word lists, patterns and templates that results depend on."""

# Validation of web results.
MIN_RESULT_SCORE = 0.6
MIN_CONTENT_CHARS = 800
MIN_KEYWORD_HITS = 1
MAX_PRONOUN_RATIO = 0.02
FALLBACK_ROWS = 3
MISSING_QUERY = "UNKNOWN_QUERY"

# Words ignored when a query is reduced to keywords.
STOP_WORDS = (
    "what", "why", "how", "when", "where", "who", "is", "are", "was", "were", "do", "does", "did", "explain",
    "describe", "define", "with", "without", "using", "the", "a", "an", "and", "or", "of", "to", "in", "on", "for",
    "compare", "between",
)

# Words that mark a conversational tone.
PRONOUNS = ("you", "we", "let", "lets", "your", "our")

# Window chunker.
CHUNK_MIN_TOKENS = 200
CHUNK_MAX_TOKENS = 300
CHUNK_OVERLAP_TOKENS = 50
CHUNK_MERGE_LIMIT = 450

# Character splitter and chunk files.
SPLIT_SIZE = 480
SPLIT_OVERLAP = 100
SPLIT_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
MIN_SPLIT_CHARS = 20
MIN_CHUNK_CHARS = 10
MAX_CHUNK_CHARS = 8192
EMPTY_MARKER = "[EMPTY]"

# Similarity, pruning, reranking and context budget.
CHUNK_SIMILARITY = 0.35
PASSAGE_SIMILARITY = 0.3
BOOK_SIMILARITY = 0.3
PASSAGE_TOP_K = 5
PAPER_TOP_K = 20
NEAR_DUPLICATE_COSINE = 0.9
RERANK_TOP_K = 6
MIN_RERANK_SCORE = 4.5
CONTEXT_TOKENS = 900
CONTEXT_ROWS = 3
CODE_LINE_SHARE = 0.35
RERANK_WEIGHT = 0.6
SIMILARITY_WEIGHT = 0.4

# Sites and phrases that mark forum content.
FORUM_SITES = ("stackoverflow.com", "stackexchange.com")
FORUM_MARKERS = (
    "ask question", "stack overflow", "can anyone", "viewed", "asked", "share", "edited", "hot network questions",
)

# Phrases that cost half a point each when a chunk is reranked.
PENALTY_PER_PHRASE = 0.5
PENALTY_PHRASES = (
    "ask question", "asked", "viewed", "votes", "score", "edited", "answered", "accepted answer",
    "hot network questions", "community wiki", "closed as", "duplicate of", "protected question",
    "improve this question", "add a comment",
    "what do you think", "in your opinion", "according to you", "share your thoughts", "answers", "answer requested",
    "request answers", "follow question", "people also asked", "followers",
    "posted by", "comments", "discussion", "thread", "replies", "original poster", "this thread", "sorted by",
    "top comments",
    "issue", "opened by", "closed", "reopen", "this issue", "related issue", "maintainers", "contributors",
    "responses", "leave a response", "published on", "updated on", "reading time", "recommended for you",
    "can anyone", "does anyone know", "any ideas", "any suggestions", "please help", "help needed",
    "thanks in advance", "beginner question", "newbie here", "quick question",
    "what is the best", "which is better", "pros and cons", "advantages and disadvantages", "should i", "is it worth",
    "recommend", "comparison", "vs", "versus",
)

# Query and page limits.
MIN_QUERY_CHARS = 3
MAX_QUERY_CHARS = 500
DEFAULT_TOP_K = 5
MAX_TOP_K = 100
MAX_PAPER_TOP_K = 20
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
SUMMARY_CHARS = 320

# Publisher names that mean subscription access.
SUBSCRIPTION_PUBLISHERS = ("ieee", "electrical and electronics engineers", "elsevier", "springer")

# BM25 parameters.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_IDF_FLOOR = 0.25

# Instruction placed before a passage query when it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

# Message fragment -> (error code, error type), first match wins.
ERROR_FRAGMENTS = (
    ("unsupported version of sqlite3", "chroma_sqlite_incompatible", "chroma_sqlite_compatibility"),
    ("collection expecting embedding with dimension", "chroma_embedding_dimension_mismatch", "chroma_query_error"),
    ("no such table", "chroma_storage_corrupt", "chroma_storage_error"),
    ("database disk image is malformed", "chroma_storage_corrupt", "chroma_storage_error"),
)
OTHER_ERROR = "chroma_runtime_error"

# Error code -> (status number, summary).
ERROR_STATUS = (
    ("chroma_sqlite_incompatible", 503, "chroma/sqlite compatibility issue"),
    ("chroma_embedding_dimension_mismatch", 422, "embedding dimension mismatch"),
    ("embeddings_missing", 503, "local embeddings store unavailable"),
    ("chroma_storage_corrupt", 503, "local embeddings store unavailable"),
)
OTHER_STATUS = (500, "retrieval failed")

# Prompt templates. {query} and {context} are the only placeholders.
WEB_PROMPT = """You are an expert Academic Educator. Your task is to transform the provided raw DATA into a comprehensive, simplified academic guide.

        CONTEXT/QUERY: {query} 
        DATA:
        {context}

        INSTRUCTIONS:
        1. PROVIDE DEPTH: While the language should be simple, the explanation must be detailed and thorough. Do not give a summary; give a full explanation.
        2. STRUCTURE: Use the format below. Ensure the 'Detailed Explanation' section is the longest part of your response.
        3. TONE: Academic, professional, and educational.
        4. CONSTRAINTS: Use only provided data, but feel free to rephrase and expand on the logic to make it easier to understand.

        FORMAT:
        # [Title]
        
        ### Overview
        [2-3 lines summarizing the core concept]

        ### Key Concepts
        [Bullet points explaining the main terms found in the data]

        ### Detailed Academic Explanation
        [Provide a multi-paragraph, in-depth explanation here. Elaborate on how the different pieces of data connect. This section should be at least 300 words long.]"""
PASSAGE_PROMPT = """You are an expert Academic Educator. Your task is to transform the provided raw DATA into a comprehensive, simplified academic guide.

CONTEXT/QUERY: {query}
DATA:
{context}

INSTRUCTIONS:
1. PROVIDE DEPTH: While the language should be simple, the explanation must be detailed and thorough. Do not give a summary; give a full explanation.
2. STRUCTURE: Use the format below. Ensure the 'Detailed Explanation' section is the longest part of your response.
3. TONE: Academic, professional, and educational.
4. CONSTRAINTS: Use only provided data as long as it directly answers the query, but feel free to rephrase and expand on the logic to make it easier to understand.
5. REWRITE TOTALLY: If the user query and the context data are very different from each other and the data is not directly answering the query, you should rewrite the data in a way that it answers the query. Do not just summarize or give a short answer. You should rewrite the data in a way that it answers the query in a detailed and comprehensive manner.

FORMAT:
# [Title]

### Overview
[2-3 lines summarizing the core concept]

### Key Concepts
[Bullet points explaining the main terms found in the data]

### Detailed Academic Explanation
[Provide a multi-paragraph, in-depth explanation here. Elaborate on how the different pieces of data connect. This section should be at least 300 words long.]"""
