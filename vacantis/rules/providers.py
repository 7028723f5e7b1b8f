"""Field map of board payloads, one entry per platform.

Each field lists alternatives; the first non-empty one wins.  A plain entry is
a path.  ``csc a b c`` joins city, state and country; ``names p f`` joins field
``f`` of the objects in list ``p``; ``each p`` joins the members (or
their names) of list ``p``; ``url …`` fills ``{ident}`` and paths in braces.
"""

# ---------------------------------------------------------------------------
# Results depend on these exact paths and their order.
# ---------------------------------------------------------------------------
PROVIDERS = {
    "greenhouse": dict(
        jobs=["jobs"], title=["title"], url=["absolute_url"], location=["location.name", "location"],
        department=["names departments name"], posted=["updated_at"]),
    "lever": dict(
        jobs=["$"], title=["text"], url=["url https://jobs.lever.co/{ident}/{id}", "hostedUrl", "applyUrl"],
        location=["categories.location"], department=["categories.department", "categories.team"],
        type=["categories.commitment"], description=["descriptionPlain"]),
    "ashby": dict(
        jobs=["jobs", "data.jobBoard.jobPostings"], title=["title"],
        url=["url https://jobs.ashbyhq.com/{ident}/{id}", "url https://jobs.ashbyhq.com/job/{id}"],
        location=["location.name", "location", "locationName"], department=["team.name", "teamName"],
        type=["employmentType"], posted=["publishedAt", "publishedDate"], salary=["compensationTierSummary"]),
    "workable": dict(
        jobs=["jobs"], title=["title"], url=["url", "shortlink"], location=["csc city state country"],
        department=["department"], type=["employment_type", "type"], posted=["published_on", "created_at"]),
    "bamboohr": dict(
        jobs=["$", "result"], title=["jobOpeningName", "title"], url=["jobOpeningShareUrl", "url"],
        location=["csc city state country", "location"], department=["department", "departmentLabel"],
        type=["employmentStatusLabel", "type"], posted=["datePosted", "createdDate"]),
    "boon": dict(
        jobs=["$", "jobs", "data", "openings"], title=["title", "job_title"], url=["url", "apply_url"],
        location=["location", "csc city state country"], department=["department", "team"],
        type=["type", "employment_type"], posted=["created_at", "posted_date"], description=["description"],
        remote=["remote", "is_remote"]),
    "bullhorn": dict(
        jobs=["$", "data", "jobs", "results"], title=["title", "publicDescription"], url=["publicUrl", "url"],
        location=["csc address.city address.state address.countryName|address.country"],
        department=["categories.data[0].name"], type=["employmentType"],
        posted=["dateLastPublished", "dateAdded"], description=["publicDescription"]),
    "eddy": dict(
        jobs=["$", "jobs", "data", "openings"], title=["title", "job_title"], url=["url", "apply_url"],
        location=["location", "csc city state -"], department=["department"],
        type=["employment_type", "type"], posted=["created_at", "posted_date"], description=["description"]),
    "folkshr": dict(
        jobs=["$", "jobs", "data", "openings"], title=["title", "job_title"], url=["url", "apply_url"],
        location=["location.name", "location.city", "location"], department=["department.name", "department"],
        type=["employment_type", "type"], posted=["published_at", "created_at"], description=["description"]),
    "freshteam": dict(
        jobs=["$", "job_postings", "jobs", "data"], title=["title", "name"], url=["url", "apply_url"],
        location=["location.name", "location.city", "location", "branch.city", "branch.name", "branch"],
        department=["department.name", "department"], type=["type", "employment_type"],
        posted=["created_at", "published_at"], description=["description"], remote=["remote"]),
    "gem": dict(
        jobs=["$", "data", "jobs", "openings"], title=["title", "name"], url=["url", "applyUrl"],
        location=["location", "locationName", "each locations"], department=["department", "team"],
        type=["employmentType", "type"], posted=["postedAt", "createdAt"], description=["description"],
        remote=["remote"]),
    "gohire": dict(
        jobs=["$", "jobs", "data", "vacancies"], title=["title", "job_title"], url=["url", "apply_url"],
        location=["location", "csc city - country"], department=["department", "category"],
        type=["type", "employment_type"], posted=["created_at", "published_at"], description=["description"],
        salary=["salary"], remote=["remote"]),
    "icims": dict(
        jobs=["$", "jobs", "jobList", "data"], title=["title", "jobTitle"], url=["applyUrl", "detailUrl", "url"],
        location=["location", "csc city state country"], department=["department", "category"],
        type=["jobType", "employmentType"], posted=["datePosted", "postedDate"],
        description=["description", "jobDescription"]),
    "jazzhr": dict(
        jobs=["$", "jobs", "data"], title=["title", "job_title"], url=["board_url", "url"],
        location=["csc city state country"], department=["department"], type=["type", "employment_type"],
        posted=["open_date", "created_at"], description=["description", "job_description"]),
    "jobvite": dict(
        jobs=["$", "jobs", "requisitions", "data"], title=["title", "jobTitle"], url=["detailUrl", "applyUrl", "url"],
        location=["location", "csc city state country"], department=["category", "department"],
        type=["type", "employmentType"], posted=["datePosted", "date"],
        description=["description", "briefDescription"]),
    "manatal": dict(
        jobs=["$", "results", "jobs", "data"], title=["position_name", "title"], url=["apply_url", "url"],
        location=["location_name", "location", "names locations name"],
        department=["department_name", "department.name", "department"], type=["employment_type", "job_type"],
        posted=["published_date", "created_at"], description=["description"], remote=["is_remote"]),
    "pcrecruiter": dict(
        jobs=["$", "Results", "Jobs", "Positions"], title=["JobTitle", "Title", "PositionTitle"],
        url=["ApplyUrl", "Url"], location=["csc City State Country", "Location"],
        department=["Department", "Category"], type=["PositionType", "JobType"],
        posted=["DatePosted", "OpenDate"], description=["Description", "JobDescription"],
        salary=["Salary", "PayRate"]),
    "pinpoint": dict(
        jobs=["$", "data", "jobs", "postings"], title=["attributes.title", "attributes.name", "title", "name"],
        url=["attributes.url", "attributes.apply_url", "url", "apply_url", "links.self"],
        location=["attributes.location", "attributes.location_name", "location", "location_name",
                  "each attributes.locations", "each locations"],
        department=["attributes.department", "attributes.department_name", "attributes.team", "department",
                    "department_name", "team"],
        type=["attributes.employment_type", "attributes.type", "employment_type", "type"],
        posted=["attributes.published_at", "attributes.created_at", "published_at", "created_at"],
        description=["attributes.description", "description"], remote=["attributes.remote", "remote"]),
    "recooty": dict(
        jobs=["$", "jobs", "data", "results"], title=["title", "job_title"], url=["apply_url", "url"],
        location=["location", "csc city state country"], department=["department", "category"],
        type=["job_type", "employment_type"], posted=["posted_date", "created_at"], description=["description"],
        remote=["is_remote", "remote"]),
    "recruitcrm": dict(
        jobs=["$", "data", "jobs"], title=["job_title", "title"], url=["job_url", "url"],
        location=["csc city state country", "location"], department=["department"],
        type=["job_type", "employment_type"], posted=["created_on", "posted_date"],
        description=["job_description"], salary=["range min_salary max_salary currency"], remote=["is_remote"]),
    "recruitee": dict(
        jobs=["$", "offers", "jobs", "data"], title=["title", "position"],
        url=["careers_url", "url", "url https://jobs.recruitee.com/{company_slug}/{slug}"],
        location=["location", "city", "each locations"], department=["department", "category"],
        type=["employment_type", "contract_type"], posted=["published_at", "created_at"],
        description=["description"], remote=["remote"]),
    "smartrecruiters": dict(
        jobs=["$", "content", "postings", "jobs"], title=["name", "title"], url=["applyUrl", "url", "ref"],
        location=["csc location.city location.region location.country", "location"],
        department=["department.label", "department.name", "department"],
        type=["typeOfEmployment.label", "typeOfEmployment", "type"], posted=["releasedDate", "createdOn"],
        description=["jobAd.sections.jobDescription.text"], remote=["location.remote", "remote"]),
    "successfactors": dict(
        jobs=["$", "d.results", "value", "JobRequisition"],
        title=["jobReqLocale.externalTitle", "externalTitle", "jobTitle", "title"],
        url=["jobPostingUrl", "externalApplyUrl"],
        location=["location.name", "location.city", "location", "locationObj.name", "primaryLocation"],
        department=["department.name", "department.externalName", "department", "custDepartment"],
        type=["employmentType", "jobType"], posted=["postingStartDate", "createdDateTime"],
        description=["externalJobDescription", "jobDescription"]),
    "talentreef": dict(
        jobs=["$", "jobs", "data", "positions"], title=["title", "position_title"], url=["apply_url", "url"],
        location=["location", "csc city state -"], department=["department", "brand"],
        type=["job_type", "employment_type"], posted=["posted_date", "created_at"], description=["description"]),
    "zoho_recruit": dict(
        jobs=["$", "data", "jobs", "Job_Openings"], title=["Job_Opening_Name", "Posting_Title", "title"],
        url=["$apply_url", "url"], location=["csc City State Country", "Location"], department=["Department"],
        type=["Job_Type"], posted=["Date_Opened", "Created_Time"], description=["Job_Description"],
        salary=["Salary"]),
}
PAYLOAD_FIELDS = ["title", "url", "location", "department", "type", "posted", "description", "salary"]

JSONLD_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
JSONLD_LINKS = ["@graph", "itemListElement", "mainEntity"]
# where a list begins inside a script; it ends at its own bracket
SCRIPT_ARRAYS = [r"(?s)jobList\s*[=:]\s*(\[.*)", r'(?s)"requisitions"\s*:\s*(\[.*)',
                 r"(?s)jvJobs\s*[=:]\s*(\[.*)", r"(?s)jobs\s*[=:]\s*(\[.*)"]
EMBEDDED_STATE = [r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
                  r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>']

DIRECTORY_US_MARKS = ["USA", "United States", ", US", ", CA", ", NY", ", TX", ", WA", ", MA", "San Francisco",
                      "New York", "Los Angeles", "Seattle", "Boston", "Austin", "Chicago"]
DIRECTORY_LINK = r'(?i)href="/companies/([^"]+)"[^>]*>([^<]+)</a>'
DIRECTORY_SKIP = ["view", "more", "see", "all", "companies", "jobs"]
SEARCH_SKIP_HOSTS = ["linkedin.com", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "wellfound.com"]
SEARCH_CAREERS_MARKS = ["/careers", "/jobs", "/join", "/hiring"]
HARVEST_PATTERN = r"boards\.greenhouse\.io/([a-zA-Z0-9_-]+)"
HARVEST_SKIP = ["sitemap", "robots", "api", "embed"]

# Page layouts per platform: cards (first group with results wins), then parts of a card.
# A selector is ``tag``, ``.class``, ``~text`` (class contains), ``@attribute`` or two of
# these with a space (second inside first).  A card without a title part uses its link text,
# except where ``link_title`` is false.
LAYOUTS = {
    "greenhouse": dict(cards=[[".opening"], [".job-card", ".job-post", "@data-job-id"]],
                       title=["h2", "h3", ".job-title", "@data-job-title"], location=[".location", "@data-location"],
                       department=[".department", "@data-department"], min_title=1),
    "lever": dict(cards=[[".posting"], [".job-card"]], title=["h5", ".posting-title", "h4", "h3", ".title"],
                  location=[".location"], department=[".department"], type=[".commitment"], min_title=1, link_title=False),
    "ashby": dict(cards=[["~JobPosting", "~job-posting"]], title=["h3", "h4", "~title"], location=["~location"],
                  department=["~team", "~department"], min_title=1, link_title=False),
    "smartrecruiters": dict(cards=[[".job-card", ".opening", ".js-openings-load", "~job-item", "@data-job-id", ".job-listing"]],
                            title=["a", "h2", "h3", "h4", ".job-title", ".opening-title"],
                            location=[".location", ".job-location"], department=[".department"],
                            type=[".job-type", ".type"], min_title=1),
    "generic": dict(cards=[[".job"], [".job-listing"], [".job-post"], [".job-card"], [".career"], [".opening"],
                           [".position"], [".vacancy"], ["@data-job"], ["@data-job-id"], ["@data-posting"],
                           [".jobs-list li"], [".careers-list li"], [".openings-list li"], [".jobs-table tr"],
                           [".jobs tr"]],
                    title=["h1", "h2", "h3", "h4", ".title", "~title"], location=[".location", "~location", "@data-location"],
                    department=[".department", "~department", "~team"], min_title=5),
}
EXCLUDED_BLOCKS = ["nav", "footer", "header"]
EXCLUDED_CLASSES = ["nav", "footer", "header", "sidebar", "menu", "cookie", "banner", "popup"]
NOISE_TAGS = ["script", "style", "noscript", "svg", "path", "img", "video", "audio", "iframe", "canvas", "map",
              "picture", "source"]
NOISE_CLASSES = ["nav", "header", "footer", "cookie", "banner", "popup", "modal", "sidebar", "newsletter",
                 "subscribe", "social", "share", "sr-only", "visually-hidden"]
MAIN_TAGS = ["main", "article"]
SIMPLE_LIMIT = 50000
SIMPLE_TAIL = "\n\n[... content truncated ...]"
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
