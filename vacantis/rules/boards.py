"""Applicant-tracking systems: URL, page and identifier patterns."""

# ---------------------------------------------------------------------------
# Results depend on these exact types, patterns and their order.
# ---------------------------------------------------------------------------

URL_PATTERNS = {
    "greenhouse": [r"boards\.greenhouse\.io/([^/]+)", r"job-boards\.greenhouse\.io/([^/]+)",
                   r"([^.]+)\.greenhouse\.io"],
    "lever": [r"jobs\.lever\.co/([^/]+)", r"([^.]+)\.lever\.co"],
    "ashby": [r"jobs\.ashbyhq\.com/([^/]+)", r"([^.]+)\.ashbyhq\.com"],
    "workable": [r"apply\.workable\.com/([^/]+)", r"([^.]+)\.workable\.com"],
    "workday": [r"([^.]+)\.wd\d+\.myworkdayjobs\.com", r"workday\.com"],
    "bamboohr": [r"([^.]+)\.bamboohr\.com/careers", r"([^.]+)\.bamboohr\.com/jobs"],
    "zoho_recruit": [r"careers\.zohorecruitcloud\.com/([^/]+)", r"([^.]+)\.zohorecruit\.com",
                     r"recruit\.zoho\.com/([^/]+)"],
    "bullhorn": [r"([^.]+)\.bullhornstaffing\.com", r"cls\d+\.bullhornstaffing\.com/([^/]+)"],
    "gem": [r"jobs\.gem\.com/([^/]+)", r"([^.]+)\.gem\.com/careers"],
    "jazzhr": [r"([^.]+)\.applytojob\.com", r"app\.jazz\.co/([^/]+)"],
    "freshteam": [r"([^.]+)\.freshteam\.com/jobs", r"([^.]+)\.freshteam\.com"],
    "recruitee": [r"([^.]+)\.recruitee\.com", r"careers\.recruitee\.com/([^/]+)"],
    "pinpoint": [r"([^.]+)\.pinpointhq\.com", r"careers\.([^.]+)\.pinpointhq\.com"],
    "pcrecruiter": [r"([^.]+)\.pcrecruiter\.net", r"jobs\.pcrecruiter\.net/([^/]+)"],
    "recruitcrm": [r"([^.]+)\.recruitcrm\.io", r"portal\.recruitcrm\.io/([^/]+)"],
    "manatal": [r"([^.]+)\.manatal\.com", r"jobs\.manatal\.com/([^/]+)"],
    "recooty": [r"([^.]+)\.recooty\.com", r"jobs\.recooty\.com/([^/]+)"],
    "successfactors": [r"([^.]+)\.successfactors\.com", r"careers\.([^.]+)\.successfactors\.eu",
                       r"performancemanager\d*\.successfactors\.com/([^/]+)"],
    "gohire": [r"([^.]+)\.gohire\.io", r"careers\.gohire\.io/([^/]+)"],
    "folkshr": [r"([^.]+)\.folkshr\.com", r"careers\.folkshr\.com/([^/]+)"],
    "boon": [r"([^.]+)\.goboon\.co", r"referrals\.goboon\.co/([^/]+)"],
    "talentreef": [r"([^.]+)\.talentreef\.com", r"careers\.talentreef\.com/([^/]+)"],
    "eddy": [r"([^.]+)\.eddy\.com/careers", r"careers\.eddy\.com/([^/]+)"],
    "jobvite": [r"jobs\.jobvite\.com/([^/]+)", r"([^.]+)\.jobvite\.com"],
    "icims": [r"careers-([^.]+)\.icims\.com", r"([^.]+)\.icims\.com"],
    "smartrecruiters": [r"jobs\.smartrecruiters\.com/([^/]+)", r"([^.]+)\.smartrecruiters\.com"],
    "rippling": [r"ats\.rippling\.com/([^/]+)", r"([^.]+)\.rippling\.com/jobs"],
    "scalis": [r"([^.]+)\.scalis\.ai/jobs", r"scalis\.ai/([^/]+)"],
    "paylocity": [r"recruiting\.paylocity\.com/recruiting/jobs/([^/]+)", r"([^.]+)\.paylocity\.com"],
    "breezy": [r"([^.]+)\.breezy\.hr", r"breezy\.hr/p/([^/]+)"],
    "personio": [r"([^.]+)\.jobs\.personio\.de", r"([^.]+)\.jobs\.personio\.com"],
    "teamtailor": [r"([^.]+)\.teamtailor\.com", r"career\.([^.]+)\.com"],
    "wellfound": [r"wellfound\.com/company/([^/]+)", r"angel\.co/company/([^/]+)"],
}

# Identifiers that are part of a platform's own URLs, not a company's.
NOT_IDENTIFIERS = ["embed", "job_board", "js", "css", "api", "jobs", "undefined",
                   "${boardtoken}", "${ghslug}", "${board_token}"]
# The page form of the list compares greenhouse tokens with their case kept.
NOT_PAGE_TOKENS = ["embed", "job_board", "js", "css", "api", "jobs", "${boardToken}",
                   "${ghSlug}", "${board_token}", "undefined"]

# Substring rules for the quick form.
QUICK_URL = {
    "greenhouse": ["greenhouse.io"], "lever": ["lever.co"], "ashby": ["ashbyhq.com", "ashby.com"],
    "workable": ["workable.com"], "workday": ["myworkdayjobs.com"], "bamboohr": ["bamboohr.com"],
    "zoho_recruit": ["zohorecruit"], "bullhorn": ["bullhorn"], "gem": ["jobs.gem.com"],
    "jazzhr": ["applytojob.com", "jazzhr"], "freshteam": ["freshteam.com"],
    "recruitee": ["recruitee.com"], "pinpoint": ["pinpointhq.com"], "pcrecruiter": ["pcrecruiter"],
    "recruitcrm": ["recruitcrm"], "manatal": ["manatal.com"], "recooty": ["recooty.com"],
    "successfactors": ["successfactors"], "gohire": ["gohire.io"], "jobvite": ["jobvite.com"],
    "icims": ["icims.com"], "smartrecruiters": ["smartrecruiters.com"],
}

# Literal marks in the lower-cased page.  Marks with capitals can never occur
# there and are left out.
PAGE_MARKS = {
    "greenhouse": ["greenhouse.io", "grnhse_", "greenhouse-job-board"],
    "lever": ["lever.co", "lever-jobs"],
    "ashby": ["ashbyhq.com", "ashby-job-posting"],
    "workable": ["workable.com", "whr-embed", "workable-job-widget"],
    "workday": ["workday", "wd-candidate"],
    "bamboohr": ["bamboohr.com", "bamboo-job-board"],
    "zoho_recruit": ["zohorecruit", "zohorecruitcloud", "zoho-recruit"],
    "bullhorn": ["bullhorn", "bullhornstaffing"],
    "gem": ["gem.com/jobs", "gem-careers"],
    "jazzhr": ["jazzhr", "applytojob.com", "jazz.co"],
    "freshteam": ["freshteam", "freshworks"],
    "recruitee": ["recruitee", "recruitee-careers"],
    "pinpoint": ["pinpointhq", "pinpoint-careers"],
    "pcrecruiter": ["pcrecruiter"],
    "recruitcrm": ["recruitcrm"],
    "manatal": ["manatal"],
    "recooty": ["recooty"],
    "successfactors": ["successfactors"],
    "gohire": ["gohire"],
    "folkshr": ["folkshr", "folks-careers"],
    "boon": ["goboon.co", "boon-referral"],
    "talentreef": ["talentreef"],
    "eddy": ["eddy.com/careers"],
    "jobvite": ["jobvite"],
    "icims": ["icims"],
    "smartrecruiters": ["smartrecruiters"],
    "rippling": ["rippling.com", "ats.rippling"],
    "scalis": ["scalis.ai", "scalis-careers"],
    "paylocity": ["paylocity", "recruiting.paylocity"],
    "breezy": ["breezy.hr", "breezyhr"],
    "personio": ["personio", "jobs.personio"],
    "teamtailor": ["teamtailor", "career-page"],
    "wellfound": ["wellfound.com", "angel.co"],
}

# Identifier in a page, per type, in order of trust.
PAGE_IDENTIFIERS = {
    "greenhouse": [
        r'data-board-token="([^"]+)"',
        r"Grnhse\.Settings\.boardToken\s*=\s*['\"]([^'\"]+)['\"]",
        r"boards\.greenhouse\.io/embed/job_board[^\"']*[?&]for=([^&\"'#\s]+)",
        r"boardToken[\"']?\s*[:=]\s*[\"']([^\"']+)[\"']",
        r'"board_token"\s*:\s*"([^"]+)"',
        r"'board_token'\s*:\s*'([^']+)'",
        r"board:\s*[\"']([^\"']+)[\"']",
        r"boards-api\.greenhouse\.io/v1/boards/([^/\"'?#\s]+)",
    ],
    "lever": [r'data-lever-site="([^"]+)"', r"jobs\.lever\.co/([^/\"']+)/embed",
              r"jobs\.lever\.co/([^/\"']+)"],
    "ashby": [r"jobs\.ashbyhq\.com/([^/\"']+)/embed", r"jobs\.ashbyhq\.com/([^/\"']+)",
              r"api\.ashbyhq\.com/posting-api/job-board/([^/\"']+)"],
    "workable": [r"apply\.workable\.com/([^/\"']+)",
                 r"workable\.com/integrations/embed/([^/\"']+)",
                 r'"subdomain"\s*:\s*"([^"]+)"'],
    "recruitee": [r"([^./]+)\.recruitee\.com"],
    "bamboohr": [r"([^./]+)\.bamboohr\.com"],
    "smartrecruiters": [r"jobs\.smartrecruiters\.com/([^/\"']+)"],
    "jobvite": [r"jobs\.jobvite\.com/([^/\"']+)"],
    "icims": [r"careers-([^.]+)\.icims\.com", r"([^./]+)\.icims\.com"],
}
GREENHOUSE_BOARD_LINK = r"boards\.greenhouse\.io/([a-zA-Z0-9_-]+)"

PAGE_LINK_PATTERNS = [
    ("greenhouse", r"boards\.greenhouse\.io/([a-zA-Z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([a-zA-Z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([a-zA-Z0-9_-]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"),
    ("jobvite", r"jobs\.jobvite\.com/([a-zA-Z0-9_-]+)"),
    ("bamboohr", r"([a-zA-Z0-9_-]+)\.bamboohr\.com/careers"),
    ("recruitee", r"recruitee\.com/o/([a-zA-Z0-9_-]+)"),
]
NOT_LINK_IDENTIFIERS = ["embed", "js", "api", "static", "assets", "www"]

BOARD_URLS = {
    "greenhouse": "https://boards.greenhouse.io/%s",
    "lever": "https://jobs.lever.co/%s",
    "ashby": "https://jobs.ashbyhq.com/%s",
    "workable": "https://apply.workable.com/%s",
    "smartrecruiters": "https://jobs.smartrecruiters.com/%s",
    "jobvite": "https://jobs.jobvite.com/%s",
    "bamboohr": "https://%s.bamboohr.com/careers",
    "recruitee": "https://recruitee.com/o/%s",
}
API_URLS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/%s/jobs",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/%s",
    "lever": "https://jobs.lever.co/%s?mode=json",
    "workable": "https://apply.workable.com/api/v1/widget/accounts/%s",
}

PLATFORM_HOSTS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "myworkdayjobs.com",
    "bamboohr.com", "zohorecruit.com", "zohorecruitcloud.com", "bullhornstaffing.com",
    "gem.com", "applytojob.com", "jazz.co", "freshteam.com", "recruitee.com",
    "pinpointhq.com", "pcrecruiter.net", "recruitcrm.io", "manatal.com", "recooty.com",
    "successfactors.com", "successfactors.eu", "gohire.io", "folkshr.com", "goboon.co",
    "talentreef.com", "eddy.com", "jobvite.com", "icims.com", "smartrecruiters.com",
    "rippling.com", "scalis.ai", "paylocity.com", "breezy.hr", "personio.de",
    "personio.com", "teamtailor.com", "wellfound.com", "angel.co",
]
REDIRECT_PLATFORM_HOSTS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "myworkdayjobs.com",
    "bamboohr.com", "recruitee.com", "smartrecruiters.com", "jobvite.com", "icims.com",
    "rippling.com", "personio.de", "personio.com", "teamtailor.com",
]

BAD_CAREERS_URL = [
    r"/news/", r"/article/", r"/blog/", r"/press/", r"/press-release", r"slack\.com/",
    r"discord\.gg/", r"discord\.com/invite", r"community\.", r"forum\.", r"/layoffs",
    r"dub\.co/", r"bit\.ly/", r"t\.co/", r"linkedin\.com/posts", r"twitter\.com/", r"x\.com/",
]

JOB_LINK_PATTERNS = [
    r'href="([^"]+/jobs?/[^"]+)"', r'href="([^"]+/positions?/[^"]+)"',
    r'href="([^"]+/careers?/[^"]+)"', r'href="([^"]+/openings?/[^"]+)"',
    r'href="([^"]+/opportunities?/[^"]+)"', r'href="([^"]+/apply/[^"]+)"',
    r'href="([^"]+\?gh_jid=\d+[^"]*)"',
]
CAREER_LINK_PATTERNS = [
    r"""href=["']([^"']*(?:/careers|/jobs|/join-us|/hiring)[^"']*)["']""",
    r"""href=["']([^"']+)["'][^>]*>(?:[^<]*(?:Careers|Jobs|Join Us|We're Hiring)[^<]*)</a>""",
]
OUTBOUND_LINK = (r"""href=["']?(https?://(?:www\.)?[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,}"""
                 r"""(?:/[^"'>\s]*)?)["']?""")
OUTBOUND_HOST = r"https?://(?:www\.)?([a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{2,})"

SKIP_DOMAINS = [
    "twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com",
    "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "threads.net",
    "google.com", "apple.com", "microsoft.com", "amazon.com", "meta.com",
    "medium.com", "techcrunch.com", "forbes.com", "bloomberg.com",
    "reuters.com", "nytimes.com", "wsj.com", "wired.com", "theverge.com",
    "venturebeat.com", "crunchbase.com", "producthunt.com", "substack.com",
    "github.com", "gitlab.com", "bitbucket.org", "npmjs.com", "pypi.org",
    "stackoverflow.com", "developer.mozilla.org", "docs.google.com",
    "cloudflare.com", "amazonaws.com", "azure.com", "cloud.google.com",
    "vercel.com", "netlify.com", "heroku.com", "fly.io",
    "slack.com", "zoom.us", "notion.so", "figma.com", "miro.com",
    "intercom.com", "hubspot.com", "salesforce.com", "zendesk.com",
    "stripe.com", "twilio.com", "sendgrid.com", "mailchimp.com",
    "google-analytics.com", "segment.com", "amplitude.com", "mixpanel.com",
    "dropbox.com", "box.com", "drive.google.com",
    "wordpress.com", "squarespace.com", "wix.com", "webflow.io",
    "typeform.com", "calendly.com", "loom.com",
]
SKIP_DOMAIN_PARTS = [".gov", ".edu", ".org", "cdn.", "static.", "api.", "docs."]

CAREER_WORDS = ["job", "career", "position", "opening", "hiring", "apply"]
ROLE_WORDS = ["engineer", "developer", "designer", "manager", "analyst", "sales", "marketing"]
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
