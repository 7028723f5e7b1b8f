"""Title → role family, specialisation and seniority."""

# ---------------------------------------------------------------------------
# Results depend on these exact labels, patterns and their order.
# ---------------------------------------------------------------------------

ROLE_FAMILIES = {
    "software_engineering": [
        r"software\s*engineer", r"developer", r"programmer", r"frontend", r"front-end",
        r"backend", r"back-end", r"fullstack", r"full-stack",
        r"mobile\s*(developer|engineer)", r"ios\s*(developer|engineer)",
        r"android\s*(developer|engineer)", r"web\s*(developer|engineer)",
        r"api\s*(developer|engineer)", r"platform\s*engineer", r"qa\s*engineer",
        r"quality\s*engineer", r"test\s*engineer", r"sdet",
    ],
    "infrastructure": [
        r"devops", r"sre", r"site\s*reliability", r"infrastructure", r"platform",
        r"cloud\s*engineer", r"systems?\s*engineer", r"network\s*engineer",
        r"security\s*engineer", r"solutions?\s*architect",
    ],
    "data": [
        r"data\s*engineer", r"data\s*scientist", r"machine\s*learning", r"ml\s*engineer",
        r"ai\s*engineer", r"analytics", r"data\s*analyst", r"business\s*intelligence",
    ],
    "product": [
        r"product\s*manager", r"program\s*manager", r"technical\s*program",
        r"project\s*manager", r"scrum\s*master",
    ],
    "design": [
        r"product\s*designer", r"ux\s*designer", r"ui\s*designer", r"ux/ui",
        r"user\s*experience", r"user\s*interface", r"ux\s*researcher", r"design\s*lead",
    ],
    "engineering_management": [
        r"engineering\s*manager", r"eng\s*manager", r"technical\s*lead", r"tech\s*lead",
        r"team\s*lead", r"director.*engineering", r"vp.*engineering",
        r"head\s*of\s*engineering", r"cto",
    ],
    "sales": [
        r"sales\s*engineer", r"solutions?\s*engineer", r"account\s*executive",
        r"sales\s*representative", r"business\s*development", r"sales\s*manager",
    ],
    "marketing": [
        r"marketing", r"growth", r"content\s*writer", r"copywriter",
        r"developer\s*advocate", r"developer\s*relations", r"devrel",
    ],
    "customer_success": [
        r"customer\s*success", r"customer\s*support", r"support\s*engineer",
        r"technical\s*support",
    ],
    "operations": [r"operations", r"ops\s*manager", r"business\s*operations"],
    "people": [r"recruiter", r"talent", r"hr\s*", r"human\s*resources", r"people\s*"],
    "finance": [r"finance", r"accountant", r"financial", r"controller", r"cfo"],
    "legal": [r"legal", r"counsel", r"attorney", r"lawyer", r"compliance"],
}
DEFAULT_ROLE_FAMILY = "other"
ALL_ROLE_FAMILIES = [*ROLE_FAMILIES, DEFAULT_ROLE_FAMILY]

SPECIALIZATIONS = {
    "frontend": [r"frontend", r"front-end", r"front end", r"react", r"vue", r"angular", r"ui\s*engineer"],
    "backend": [r"backend", r"back-end", r"back end", r"server", r"api"],
    "fullstack": [r"fullstack", r"full-stack", r"full stack"],
    "mobile": [r"mobile", r"ios", r"android", r"react\s*native", r"flutter"],
    "ios": [r"\bios\b", r"swift", r"objective-c"],
    "android": [r"android", r"kotlin"],
    "devops": [r"devops", r"dev\s*ops"],
    "sre": [r"\bsre\b", r"site\s*reliability"],
    "ml": [r"machine\s*learning", r"\bml\b", r"deep\s*learning"],
    "data": [r"data\s*engineer", r"data\s*pipeline", r"etl"],
    "security": [r"security", r"infosec", r"appsec", r"cybersecurity"],
    "cloud": [r"\baws\b", r"azure", r"\bgcp\b", r"cloud"],
    "platform": [r"platform"],
}

FIELD_FAMILIES = {
    "Software Engineering": "software_engineering",
    "Frontend Development": "software_engineering",
    "Backend Development": "software_engineering",
    "Full Stack Development": "software_engineering",
    "Mobile Development (iOS)": "software_engineering",
    "Mobile Development (Android)": "software_engineering",
    "DevOps / SRE": "infrastructure",
    "Cloud / Infrastructure": "infrastructure",
    "Data Engineering": "data",
    "Data Science": "data",
    "Machine Learning / AI": "data",
    "Security Engineering": "infrastructure",
    "QA / Testing": "software_engineering",
    "Product Management": "product",
    "Product Design": "design",
    "UX Research": "design",
    "UI/UX Design": "design",
    "Technical Program Management": "product",
    "Engineering Management": "engineering_management",
    "Solutions Architecture": "infrastructure",
    "Technical Writing": "other",
    "Developer Relations": "marketing",
    "Sales Engineering": "sales",
    "Sales / Account Executive": "sales",
    "Business Development": "sales",
    "Customer Success": "customer_success",
    "Marketing": "marketing",
    "Growth Marketing": "marketing",
    "Content Marketing": "marketing",
    "Product Marketing": "marketing",
    "Operations": "operations",
    "People / HR": "people",
    "Finance": "finance",
    "Legal": "legal",
    "Other": "other",
}

SENIORITY_LEVELS = [
    "intern", "junior", "mid", "senior", "staff", "principal", "director", "vp", "c_level",
]

SENIORITY_TITLES = {
    "c_level": [r"\bceo\b", r"\bcto\b", r"\bcfo\b", r"\bcoo\b", r"\bcmo\b", r"\bchief\b",
                r"\bco-founder\b", r"\bfounder\b"],
    "vp": [r"\bvp\b", r"\bvice\s*president\b", r"\bsvp\b", r"\bevp\b"],
    "director": [r"\bdirector\b", r"\bhead\s+of\b"],
    "principal": [r"\bprincipal\b", r"\bdistinguished\b", r"\bfellow\b"],
    "staff": [r"\bstaff\b", r"\bsr\.\s*staff\b"],
    "senior": [r"\bsenior\b", r"\bsr\.?\b", r"\bsr\s+", r"\blead\b"],
    "mid": [r"\bmid-?level\b", r"\bintermediate\b", r"\bii\b"],
    "junior": [r"\bjunior\b", r"\bjr\.?\b", r"\bentry\s*level\b", r"\bnew\s*grad\b",
               r"\bgraduate\b", r"\bi\b"],
    "intern": [r"\bintern\b", r"\binternship\b", r"\bco-?op\b"],
}
DEFAULT_SENIORITY = "mid"

YEARS_OF_EXPERIENCE = r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s*)?(?:experience|exp)"
YEARS_RANGE = r"(\d+)-(\d+)\s*(?:years?|yrs?)"
# (years below, level); at or above the last bound the level is "principal"
EXPERIENCE_BANDS = [(1, "intern"), (2, "junior"), (5, "mid"), (8, "senior"), (12, "staff")]
EXPERIENCE_TOP = "principal"

SENIORITY_DISPLAY = {
    "intern": "Intern", "junior": "Junior", "mid": "Mid-level", "senior": "Senior",
    "staff": "Staff", "principal": "Principal", "director": "Director", "vp": "VP",
    "c_level": "Executive",
}

# Employment type: the first label with a contained phrase wins.
EMPLOYMENT_TYPES = {
    "full_time": ["full-time", "full time", "permanent"],
    "part_time": ["part-time", "part time"],
    "contract": ["contract", "contractor"],
    "freelance": ["freelance"],
    "internship": ["intern", "internship"],
}
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
