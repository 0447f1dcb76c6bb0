"""Fixed values. These must keep their exact spelling and order for results to agree."""

# --- scoring ---------------------------------------------------------------
CATEGORY_SCORES = {
    "strong_match": 10,
    "minor_gaps": 7,
    "experience_mismatch": 2,
    "skills_mismatch": 1,
    "no_match": 0,
}
MATCHED_CATEGORIES = ["strong_match", "minor_gaps"]
STRONG_COVERAGE = 0.80
MINOR_COVERAGE = 0.6
PREFERRED_BONUS_COVERAGE = 0.8
HIGH_SCORE = 8

# --- posting rules ---------------------------------------------------------
BLOCKED_COMPANIES = ["scoutit"]
MIN_DESCRIPTION_CHARS = 300
FRESHNESS_DAYS = 14
RETENTION_DAYS = 14
SENIOR_CANDIDATE_ABOVE = 5

SENIOR_TITLE_KEYWORDS = [
    "director", "vp ", "vice president", "principal engineer", "staff engineer", "architect",
    "head of", "lead", "manager", "chief", "cto", "sde4", "sde 4", "sde iv", "senior manager",
    "senior director", "senior lead", "staff software engineer", "distinguished engineer",
    "engineering manager", "tech lead",
]
JUNIOR_TITLE_KEYWORDS = [
    "fresher", "intern ", "internship", "junior", "jr.", "jr ", "graduate trainee", "trainee",
    "apprentice", "entry level", "entry-level", "sde1", "sde 1", "sde i",
]

# --- tiers -----------------------------------------------------------------
FREE, PREMIUM = "free", "premium"
TIERS = [  # tier, emoji, label, alerts per day
    (FREE, "🔹", "Free", 1),
    (PREMIUM, "⭐", "Premium", 3),
]
PREMIUM_PRICE_INR = 500
TRIAL_DAYS = 7
LOCAL_ZONE = "Asia/Kolkata"

# --- search tasks ----------------------------------------------------------
TITLES_PER_USER = 5
SINGLE_LOCATION_PLATFORMS = ["naukri", "indeed"]
TASK_BATCH_SIZES = {"linkedin": 10, "naukri": 3}
GEO_IDS = {
    "bengaluru": "90009633",
    "bangalore": "90009633",
    "hyderabad": "90009650",
    "mumbai": "90009639",
    "pune": "114806696",
    "chennai": "106888327",
    "india": "102713980",
}
DEFAULT_LOCATIONS = [
    ("Bengaluru", "90009633"), ("Hyderabad", "90009650"), ("Mumbai", "90009639"),
    ("Delhi", "106187582"), ("Gurugram", "115884833"), ("Noida", "104869687"),
    ("Pune", "114806696"), ("Chennai", "106888327"), ("India", "102713980"),
]
INDIAN_PLACES = (
    "bengaluru|bangalore|hyderabad|mumbai|pune|chennai|delhi|gurugram|noida|kolkata|ahmedabad|india"
)
NAMED_LOOKBACKS = {
    "past month": "r2592000",
    "past week": "r604800",
    "24hr": "r86400",
    "past 24 hours": "r86400",
}

# --- model prices per million tokens (USD) and per posting ------------------
PRICE_CACHE_HIT = 0.014
PRICE_CACHE_MISS = 0.14
PRICE_COMPLETION = 0.28
PRICE_PER_POSTING = 0.001

# --- click counters ----------------------------------------------------------
CLICK_KEYS = ["telegram_apply", "telegram_resume", "dashboard_apply", "dashboard_resume"]

# --- queue -------------------------------------------------------------------
SLOT_MINUTES = 30
QUEUE_EXPIRY_DAYS = 4

# --- blocked pages -----------------------------------------------------------
BLOCKED_TITLE_WORDS = [
    "just a moment...", "cloudflare", "attention required", "access denied", "security check",
    "captcha", "pardon our interruption", "are you a human", "validate your request",
    "unusual traffic",
]
BLOCKED_URL_WORDS = [
    "cloudflare", "challenge", "captcha", "blocked", "access-denied", "robot", "verify",
]

# --- skills ------------------------------------------------------------------
# Members of one group stand in for each other.
SKILL_GROUPS = {
    "cloud": ["aws", "gcp", "azure"],
    "orchestration": ["kubernetes", "k8s", "docker swarm", "nomad"],
    "runtime": ["node.js", "deno", "bun"],
    "relational": ["postgresql", "mysql", "sql server", "oracle"],
    "nosql": ["mongodb", "dynamodb", "cassandra", "couchbase"],
    "ci": ["github actions", "gitlab ci", "jenkins", "circleci"],
    "iac": ["terraform", "pulumi", "cloudformation", "cdk"],
    "api": ["rest", "graphql", "grpc"],
    "queue": ["kafka", "rabbitmq", "sqs", "pub/sub"],
    "monitoring": ["prometheus", "datadog", "new relic", "grafana"],
    "cache": ["redis", "memcached", "elasticache"],
}
# This group counts for preferred skills only.
PREFERRED_SKILL_GROUPS = {"frontend": ["react", "vue", "angular", "svelte"]}
# Having the key means having the values.
SKILL_LINEAGE = {
    "node.js": ["javascript"],
    "express": ["javascript"],
    "fastify": ["javascript"],
    "spring boot": ["java"],
    "fastapi": ["python"],
    "django": ["python"],
    "flask": ["python"],
    "react": ["javascript", "typescript"],
    "next.js": ["javascript", "typescript"],
    "angular": ["javascript", "typescript"],
    "typescript": ["javascript"],
    "sveltekit": ["typescript", "javascript"],
}

# --- search request values per platform ---------------------------------------
DATE_POSTED_VALUES = ["past month", "past week", "24hr", "past 24 hours"]
JOB_TYPE_VALUES = [
    "full time", "full-time", "part time", "part-time", "contract", "temporary", "volunteer",
    "internship", "f", "p", "c", "t", "v", "i",
]
EXPERIENCE_VALUES = [
    "internship", "entry level", "associate", "senior", "director", "executive",
    "1", "2", "3", "4", "5", "6",
]
REMOTE_VALUES = ["on-site", "on site", "remote", "hybrid", "1", "2", "3"]
SORT_VALUES = ["recent", "relevant", "dd", "r"]
JOB_AGE_VALUES = [1, 3, 7, 15, 30]
NAUKRI_SORT_VALUES = ["relevance", "date", "r", "f"]
WFH_VALUES = ["office", "remote", "hybrid", "0", "2", "3"]
INDEED_JOB_TYPES = ["fulltime", "parttime", "contract", "internship", "temporary"]
PLAIN_SORT_VALUES = ["relevance", "date"]
SIMPLYHIRED_DATES = ["24hr", "3days", "7days", "14days", "30days", "1", "3", "7", "14", "30"]
SIMPLYHIRED_JOB_TYPES = [
    "fulltime", "parttime", "contract", "internship", "temporary", "permanent", "freelance",
    "temp-to-hire", "CF3CP", "NJXCK", "75GKK", "5QWDV", "ZG59D", "7SBAT", "4HKF7", "VDTG7",
]
