"""Fixed values of the data model: word lists, patterns, limits and weights."""

# Extensions and names of plain files that become one chunk each.
PLAIN_EXTENSIONS = "json yaml yml toml sh bash dockerfile conf ini xml md mdx".split()
PLAIN_NAMES = ["Makefile", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore", ".gitignore", ".npmrc", ".nvmrc", ".editorconfig"]
DOC_EXTENSIONS = "md mdx txt".split()
DOC_NAMES = ["README", "README.md", "README.mdx", "CHANGELOG", "CHANGELOG.md", "CHANGELOG.txt", "HISTORY", "HISTORY.md", "ROADMAP.md", "NOTES.md", "RUNBOOK.md"]
SKIPPED_DIRS = ["node_modules", ".git", "dist", ".codeloam"]
PLAIN_BYTES, DOC_BYTES, DOC_BODY_CHARS, DOC_SECTIONS, DOC_ENTRIES = 32_000, 96_000, 4_000, 24, 120
RESULT_CHARS, HISTORY_DEPTH, VECTOR_DIMS = 12_000, 150, 384

# Words that are no topics, of changes, of documents, and of questions.
CHANGE_STOP_WORDS = (
    "the and with from that this were have into after before when while over under then than your their feature change changes fix fixed update updated updates "
    "refactor cleanup chore docs test tests readme index src lib app dist build file files code project main util utils common module modules component components"
).split()
DOCUMENT_STOP_WORDS = (
    "the and with from that this were have into after before when while over under then than your their readme docs documentation guide notes project section "
    "file files about using used local system code overview introduction general detail details example examples"
).split()
QUESTION_STOP_WORDS = "the how what where does get set use for with from and that this are was not but file code function class method".split()

# Classifiers, first match wins; the parts match anywhere in a word.
CHANGE_TYPES = [
    ("fix", "fix|bug|hotfix|regression|error|race|crash|broken|issue"),
    ("feature", "feat|feature|add|introduc|implement|support|create"),
    ("refactor", "refactor|rewrite|cleanup|simplif|reorgan"),
    ("docs", "readme|doc|docs|changelog|adr|guide"),
    ("test", "test|spec|assert|fixture|jest|vitest|cypress"),
    ("ops", "ci|build|deploy|docker|k8s|release|infra|ops"),
]
#: (type, pattern on the path or None, pattern on path, title and body)
DOCUMENT_TYPES = [
    ("changelog", r"(^|/)(changelog|history)(\.|/|$)", "release notes|migration guide"),
    ("decision", r"(^|/)(adr|adrs|decisions)(/|$)", "adr|decision|tradeoff|rationale"),
    ("architecture", None, "architecture|design|system|structure|call graph|storage layout"),
    ("operations", None, "runbook|deploy|deployment|operations|incident|oncall|ops|troubleshoot"),
    ("feature", None, "what it does|features|capabilities|feature map|overview|introduction"),
    ("overview", None, "readme|getting started|setup|usage"),
]
FEATURE_DENY = "setup|requirements|project status and history|development|index a project|query a project|vs code integration"
FEATURE_ALLOW = "what it does|overview|features|capabilities|architecture|system|storage layout|language support|mcp server"
FIX_QUESTION = "bug|fix|broken|incident|regression|issue|error"
FACT_QUESTION = "what does|what is|feature|capabilit|architecture|overview|design|how .*work|system|status"

# Weights of topic tokens and of the re-ranking.
CHANGE_WEIGHTS = {"title": 4, "body": 2, "files": 3, "symbols": 4, "hints": 2}
DOCUMENT_WEIGHTS = {"path": 3, "title": 5, "body": 1, "doc_type": 2}
COSINE_WEIGHT, FRESHNESS_WEIGHT, DOCUMENT_BONUS, FACT_BONUS, FIX_BONUS = 0.72, 0.16, 0.06, 0.20, 0.15
DOCUMENT_DAYS, DOCUMENT_FLOOR, CHANGE_DAYS = 365, 0.2, 180
