"""Text, news, page and domain rules that fit no larger table."""

# ---------------------------------------------------------------------------
# Results depend on these exact words, patterns and limits.
# ---------------------------------------------------------------------------

STOP_WORDS = [
    "a", "an", "the", "and", "or", "at", "in", "on", "for", "to", "of",
    "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "shall", "can", "need", "we", "you", "our",
    "your", "their", "this", "that", "with", "from", "by", "as", "about",
    "job", "position", "role", "opportunity", "career", "hiring", "apply",
    "now", "remote", "hybrid", "onsite", "full", "time", "part",
]

COMPANY_SUFFIX = r"\s*(inc\.?|corp\.?|llc|ltd\.?|co\.?|company|technologies|labs?)\s*$"
SLUG_SUFFIX = r"\s*(inc\.?|corp\.?|llc|ltd\.?|co\.?|company)\s*$"

SALARY_SNIPPETS = [
    r"\$[\d,]+(?:\s*-\s*\$[\d,]+)?(?:\s*(?:per|/)\s*(?:year|yr|hour|hr))?",
    r"[\d,]+k\s*-\s*[\d,]+k",
    r"£[\d,]+(?:\s*-\s*£[\d,]+)?",
    r"€[\d,]+(?:\s*-\s*€[\d,]+)?",
]

FUNDING_KEYWORDS = [
    "raises", "raised", "funding", "series a", "series b", "series c",
    "series d", "seed round", "seed funding", "million", "billion",
    "investment", "invested", "venture", "capital", "fundraise",
    "financing", "valuation", "unicorn", "backed", "led by",
]
FUNDING_STAGES = {
    "series d": "Series D", "series c": "Series C", "series b": "Series B",
    "series a": "Series A", "seed round": "Seed", "seed funding": "Seed",
    "pre-seed": "Pre-Seed",
}
NEWS_RAISES = (r"([A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)?)\s+"
               r"(?:raises?|raised|secures?|secured|closes?|closed)\s+\$\d+")
NEWS_AMOUNT_FOR = (r"\$\d+(?:\.\d+)?\s*(?:million|billion|M|B)\s+(?:for|to|into)\s+"
                   r"([A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)?)")
NEWS_URL = r"https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-z]{2,})"
NEWS_SKIP_WORDS = [
    "the", "a", "an", "this", "that", "these", "those",
    "series", "round", "seed", "funding", "million", "billion",
    "startup", "company", "venture", "capital", "investment",
    "today", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday", "announces", "raises",
    "has", "will", "can", "could", "would", "should",
    "last", "next", "first", "second", "third",
    "year", "month", "week", "day", "time",
    "new", "old", "big", "small", "more", "less",
    "all", "some", "any", "most", "many", "few",
    "now", "then", "here", "there", "just", "only",
    "also", "even", "still", "already", "yet",
    "net", "gross", "total", "average", "median",
    "stakes", "shares", "equity", "stock", "bond",
]
NEWS_SKIP_DOMAINS = ["techcrunch.com", "venturebeat.com", "crunchbase.com", "twitter.com",
                     "linkedin.com", "facebook.com", "youtube.com"]

ORG_EDU_WORDS = ["university", "college", "school", "lab", "research", "academic", "edu"]
ORG_SKIP_WORDS = [
    "foundation", "non-profit", "nonprofit", "charity",
    "government", "city of", "county", "state of",
    "giants", "49ers", "warriors", "athletics", "sports", "team",
    "pride", "parade", "festival", "event",
    "church", "temple", "mosque", "synagogue", "religious",
    "museum", "library", "archive",
]

RENDER_MARKS = [
    "__next_data__", "__nuxt__", "react-root", "ng-app", "vue-app", 'id="app"',
    "data-reactroot", "loading...", "please wait", "spinner", 'class="loader"',
    'class="loading"', '<div class="job-listings"></div>', '<div class="jobs-list"></div>',
    '<ul class="job-list"></ul>', "no jobs found",
]
CAREERS_PHRASES = [
    "job opening", "open position", "career opportunities", "we're hiring", "we are hiring",
    "join our team", "current openings", "apply now", "view all jobs", "browse jobs",
]

NAVIGATION_TEXT = [
    r"^view\s+(all|more|job)", r"^see\s+(all|more)", r"^apply\s+now", r"^learn\s+more",
    r"^read\s+more", r"^click\s+here", r"^back\s+to", r"^home$", r"^about$", r"^contact$",
    r"^careers?$", r"^jobs?$",
]
GENERIC_JOB_HREF = [r"/jobs?/", r"/careers?/", r"/positions?/", r"/openings?/",
                    r"/opportunities/", r"/apply/"]

BAD_IDENTIFIER = [
    r"\$\{", r"\$\(", r"<[^>]+>", r"class=", r"div>", r"\\n", r"console\.", r"fetch\(",
    r"response\.", r"elementor", r"data-domain=", r"script>", r'\\"', r"!res\.ok",
]
PLACEHOLDER_IDENTIFIERS = ["${ASHBY_ORG}", "null", "undefined", "The"]

DOMAIN_PLATFORM_PARTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "workday.com",
                         "myworkdayjobs.com"]

SUPPORTED_PLATFORMS = ["greenhouse", "lever", "ashby", "workable", "jobvite", "workday"]

DESCRIPTION_JSON = r'"description"\s*:\s*"((?:[^"\\]|\\.)*+)"'
DESCRIPTION_BLOCKS = [
    r'<div[^>]*class="[^"]*job-description[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*jobDescription[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*posting-description[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</div>',
    r'<section[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</section>',
    r"<article[^>]*>(.*?)</article>",
]
POSTED_PATTERNS = [r'"datePosted"\s*:\s*"([^"]+)"', r"Posted:\s*(\d{4}-\d{2}-\d{2})",
                   r"posted[^>]*>([^<]+\d{4})"]
MIN_DESCRIPTION = 100
MIN_DESCRIPTION_LEVER = 50

JOB_ID_PATTERNS = {
    "greenhouse": [r"[?&]gh_jid=(\d+)", r"/jobs/(\d+)", r"/careers/(\d+)"],
    "ashby": [r"jobs\.ashbyhq\.com/[^/]+/([a-f0-9-]+)"],
    "workable": [r"/j/([A-Za-z0-9]+)"],
}

FRESHNESS_BUCKETS = ["Today", "Yesterday", "2-7 days", "8-14 days", "15-30 days",
                     "31-60 days", "60+ days", "No date"]
FRESHNESS_EDGES = [(1, "Today"), (2, "Yesterday"), (7, "2-7 days"), (14, "8-14 days"),
                   (30, "15-30 days"), (60, "31-60 days")]
QUEUE_STATUSES = ["pending", "processing", "completed", "review", "failed"]

# Board-link patterns: (type, pattern); group 1 is the address, group 2 the identifier.
BOARD_LINKS = [
    ("greenhouse", r"""href=["']?(https?://boards\.greenhouse\.io/([a-zA-Z0-9_-]+))["'\s>]"""),
    ("greenhouse", r"""href=["']?(https?://[a-zA-Z0-9_-]+\.greenhouse\.io/([a-zA-Z0-9_-]+)?)["'\s>]"""),
    ("greenhouse", r"""(boards\.greenhouse\.io/([a-zA-Z0-9_-]+))"""),
    ("lever", r"""href=["']?(https?://jobs\.lever\.co/([a-zA-Z0-9_-]+))["'\s>/]"""),
    ("lever", r"""(jobs\.lever\.co/([a-zA-Z0-9_-]+))"""),
    ("ashby", r"""href=["']?(https?://jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+))["'\s>/]"""),
    ("ashby", r"""(jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+))"""),
    ("workable", r"""href=["']?(https?://apply\.workable\.com/([a-zA-Z0-9_-]+))["'\s>/]"""),
    ("workable", r"""(apply\.workable\.com/([a-zA-Z0-9_-]+))"""),
    ("bamboohr", r"""href=["']?(https?://([a-zA-Z0-9_-]+)\.bamboohr\.com/jobs)["'\s>/]"""),
    ("recruitee", r"""href=["']?(https?://([a-zA-Z0-9_-]+)\.recruitee\.com)["'\s>/]"""),
    ("breezy", r"""href=["']?(https?://([a-zA-Z0-9_-]+)\.breezy\.hr)["'\s>/]"""),
    ("smartrecruiters", r"""href=["']?(https?://jobs\.smartrecruiters\.com/([a-zA-Z0-9_-]+))["'\s>/]"""),
    ("jobvite", r"""href=["']?(https?://jobs\.jobvite\.com/([a-zA-Z0-9_-]+))["'\s>/]"""),
]
BOARD_LINK_SKIP = ["embed", "jobs", "api", "static", "assets", "cdn", "www", "app", "admin",
                   "login", "signup", "careers"]
BOARD_LINK_HOSTS = {
    "greenhouse": "boards.greenhouse.io", "lever": "jobs.lever.co", "ashby": "jobs.ashbyhq.com",
    "workable": "apply.workable.com", "smartrecruiters": "jobs.smartrecruiters.com",
    "jobvite": "jobs.jobvite.com",
}
BOARD_LINK_URLS = {
    "bamboohr": "https://%s.bamboohr.com/jobs", "recruitee": "https://%s.recruitee.com",
    "breezy": "https://%s.breezy.hr",
}

CHUNK_SIZE = 6000
CHUNK_OVERLAP = 500
CHUNK_LOOK_BACK = 200
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
