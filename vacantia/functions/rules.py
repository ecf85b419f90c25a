"""Word lists, rules and limits that results depend on.

Everything here is plain data.  The functions that use these tables take them as
arguments, so a caller can pass another lexicon or other rules.
"""

# --- fixed values: limits -------------------------------------------------------------
MIN_INGEST_DESCRIPTION = 30
MIN_PREPARED_DESCRIPTION = 120
DESCRIPTION_CHARS_FOR_SENIORITY = 400
MIN_SENTENCE_CHARS = 40
MAX_CHUNK_CHARS = 420
MIN_CHUNK_CHARS = 40
CANDIDATE_POOL = 200
RETRIEVAL_FACTOR = 4
RATE_LIMIT_REQUESTS = 20
RATE_LIMIT_WINDOW_SECONDS = 60
STALE_AFTER_HOURS = 24

# --- fixed values: score weights ------------------------------------------------------
WEIGHT_EMBEDDING = 0.70
WEIGHT_SKILLS = 0.20
WEIGHT_CATEGORY = 0.07
WEIGHT_SENIORITY = 0.03
WEIGHT_RETRIEVAL = 0.8
WEIGHT_KEYWORDS = 0.2

# --- fixed values: category of a title, first group that has a phrase in the title wins ---
ROLE_PHRASES = {
    "machine learning": [
        "machine learning engineer", "ml engineer", "mlops engineer", "ai engineer",
        "applied scientist", "research scientist", "data scientist",
        "computer vision engineer", "nlp engineer", "llm engineer",
        "artificial intelligence engineer", "deep learning engineer",
        "ml platform engineer", "ai/ml engineer",
    ],
    "data engineering": [
        "data engineer", "analytics engineer", "etl engineer", "etl developer",
        "data platform engineer", "data warehouse engineer", "warehouse engineer",
        "big data engineer", "data infrastructure engineer", "data pipeline engineer",
        "data integration engineer", "bi engineer", "business intelligence engineer",
    ],
    "software engineering": [
        "software engineer", "backend engineer", "back-end engineer",
        "backend developer", "back-end developer", "platform engineer",
        "api engineer", "python engineer", "python developer",
        "full stack engineer", "full-stack engineer", "full stack developer",
        "full-stack developer", "web developer", "application developer",
        "devops engineer", "dev ops engineer", "site reliability engineer", "sre",
        "cloud engineer", "infrastructure engineer", "systems engineer",
        "solutions engineer", "integration engineer", "embedded engineer",
        "firmware engineer",
    ],
}

# --- fixed values: substrings that mark a technical title ---
TECH_TITLE_WORDS = [
    "engineer", "developer", "scientist", "machine learning", "ml ", "mlops", "data ",
    "analytics", "backend", "back-end", "software", "platform", "api", "python",
    "devops", "cloud", "infrastructure", "sre", "site reliability",
]

# --- fixed values: seniority found in level + title, first rule wins.
# A plain phrase matches anywhere; a phrase in `words` matches only as a whole word.
SENIORITY_RULES = [
    {"label": "Intern", "phrases": ["intern", "internship", "working student", "trainee"], "words": []},
    {"label": "Principal", "phrases": ["principal"], "words": []},
    {"label": "Staff", "phrases": ["staff engineer"], "words": ["staff"]},
    {"label": "Lead", "phrases": ["lead", "head of", "tech lead", "team lead"], "words": []},
    {"label": "Senior", "phrases": ["senior"], "words": ["sr"]},
    {"label": "Junior", "phrases": ["junior"], "words": ["jr"]},
    {"label": "Mid", "phrases": ["mid-level", "mid level", "intermediate"], "words": []},
]

# --- fixed values: seniority labels of ingested rows; others are title-cased ---
SENIORITY_SYNONYMS = {
    "junior": "Junior",
    "jr": "Junior",
    "mid": "Mid",
    "middle": "Mid",
    "intermediate": "Mid",
    "senior": "Senior",
    "sr": "Senior",
    "lead": "Lead",
    "staff": "Staff",
    "principal": "Principal",
}

# --- fixed values: skill -> phrases that name it, each matched as whole words ---
SKILL_LEXICON = {
    "python": ["python"],
    "sql": ["sql", "t-sql"],
    "postgresql": ["postgresql", "postgres"],
    "mysql": ["mysql"],
    "sqlite": ["sqlite"],
    "mongodb": ["mongodb", "mongo db"],
    "redis": ["redis"],
    "elasticsearch": ["elasticsearch", "elastic search"],
    "snowflake": ["snowflake"],
    "databricks": ["databricks"],
    "dbt": ["dbt", "data build tool"],
    "airflow": ["airflow", "apache airflow"],
    "spark": ["spark", "apache spark", "pyspark"],
    "hadoop": ["hadoop"],
    "kafka": ["kafka", "apache kafka"],
    "etl": ["etl", "extract transform load"],
    "data-warehouse": ["data warehouse", "data warehousing"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "django": ["django"],
    "sqlalchemy": ["sqlalchemy"],
    "api": ["api", "apis", "rest api", "restful api", "graphql"],
    "docker": ["docker"],
    "kubernetes": ["kubernetes", "k8s"],
    "terraform": ["terraform"],
    "ci-cd": [
        "ci/cd", "ci cd", "continuous integration", "continuous delivery",
        "continuous deployment",
    ],
    "aws": ["aws", "amazon web services"],
    "gcp": ["gcp", "google cloud", "google cloud platform"],
    "azure": ["azure", "microsoft azure"],
    "cloud": ["cloud", "cloud-native", "cloud native"],
    "linux": ["linux"],
    "git": ["git", "github", "gitlab"],
    "java": ["java"],
    "golang": ["golang", "go lang", "go"],
    "javascript": ["javascript", "js"],
    "typescript": ["typescript", "ts"],
    "react": ["react", "reactjs", "react.js"],
    "nodejs": ["node.js", "nodejs"],
    "pandas": ["pandas"],
    "numpy": ["numpy"],
    "scikit-learn": ["scikit-learn", "scikit learn", "sklearn"],
    "pytorch": ["pytorch"],
    "tensorflow": ["tensorflow"],
    "xgboost": ["xgboost"],
    "machine-learning": ["machine learning", "ml"],
    "deep-learning": ["deep learning"],
    "nlp": ["nlp", "natural language processing"],
    "llm": ["llm", "llms", "large language model", "large language models"],
    "rag": ["rag", "retrieval augmented generation"],
    "embeddings": ["embedding", "embeddings"],
    "transformers": ["transformers", "transformer", "hugging face"],
    "faiss": ["faiss"],
    "vector-search": ["vector search", "semantic search", "vector database"],
    "business-intelligence": ["business intelligence", "bi"],
    "dashboarding": ["dashboard", "dashboards", "reporting"],
    "data-analysis": ["analytics", "data analysis", "analyst"],
    "excel": ["excel", "microsoft excel"],
}

# --- fixed values: words left out of the common terms of an answer ---
TERM_STOPWORDS = [
    "the", "and", "for", "with", "using", "use", "work", "build",
    "data", "job", "role", "required", "preferred", "experience",
    "python", "based", "support", "team", "systems", "services",
]

# --- fixed values: answer and prompt texts ---
NO_ANSWER = "No relevant job posting information was found for the given question and filters."
HEADER_JOBS = "Relevant job postings:"
HEADER_GENERAL = "Based on the retrieved job postings:"
HEADER_EXAMPLES = "Relevant examples:"
TERMS_PREFIX = "Common themes across the retrieved postings include: "
PROMPT_HEAD = (
    "You are answering questions about job postings.\n\n"
    "Use only the provided context.\n"
    "Do not invent facts.\n"
    "If the context is insufficient, say so briefly.\n\n"
    "Question:\n"
)
PROMPT_CONTEXT = "\n\nContext:\n"
PROMPT_TAIL = "\n\nAnswer in a concise and clear way.\n"

# --- fixed values: evaluation questions ---
