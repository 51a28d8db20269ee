"""Fixed values of the task, and the session a job starts from."""

from __future__ import annotations

from pyspark.sql import SparkSession

# --- Fixed values: labels ---
LABEL_IDS = {"corporate_seo": 0, "personal_blog": 1}
LABEL_NAMES = {0: "corporate_seo", 1: "personal_blog"}

# --- Fixed values: URL expansion ---
MAX_LINKS = 25
DEBUG_SEEDS = 20

# --- Fixed values: tags whose text is kept, in the order they are listed ---
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "article")

# --- Fixed values: URL features ---
DEV_SUFFIXES = (".dev", ".me", ".io", ".xyz", ".fyi", ".page")
GITHUB_PART = "github.io"
NEOCITIES_PART = "neocities.org"

# --- Fixed values: structural features ---
GENERATORS = ("hugo", "jekyll", "wordpress")
HUBSPOT_PART = "js.hs-scripts.com"

# --- Fixed values: content features ---
PERSONAL_PRONOUNS = ("i", "me", "my")
CORPORATE_PRONOUNS = ("we", "our", "company")
CORPORATE_KEYWORDS = ("solutions", "enterprise", "platform", "services", "b2b")

# --- Fixed values: text vectorizers ---
HASH_BUCKETS = 65536
WORD_NGRAMS = (1, 2)
WORD_VOCABULARY = 5000
CHAR_NGRAMS = (3, 5)
CHAR_VOCABULARY = 10000

# --- Fixed values: split and boosted trees ---
TEST_SHARE = 0.2
SEED = 42
BOOSTING = {
    "step_size": 0.08,
    "rounds": 400,
    "leaves": 21,
    "max_bins": 63,
    "column_share": 0.7,
    "row_share": 0.7,
    "min_leaf_rows": 20,
    "patience": 50,
}

# --- Fixed values: output and progress ---
ROWS_PER_FILE = 1000
PROGRESS_SECONDS = 30

URL_FEATURES = ("url_len", "domain_len", "path_depth", "is_dev_tld", "is_github_io", "is_neocities")
STRUCTURAL_FEATURES = (
    "generator_is_hugo",
    "generator_is_jekyll",
    "generator_is_wordpress",
    "has_hubspot_script",
    "link_count",
    "form_count",
)
CONTENT_FEATURES = ("personal_pronoun_count", "corporate_pronoun_count", "corporate_keyword_count")


def session(app: str = "webstrata", **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` overrides them.

    Pages vary from a few hundred bytes to megabytes, so Arrow batches are bounded by
    bytes as well as rows.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
