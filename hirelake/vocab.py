"""Fixed values.

Every list here decides results (keyword hits, priorities, labels), so the
entries and their order are part of the data contract.  Logic lives elsewhere.
"""

# Enumerations of the posting schema.
SOURCES = (
    "remoteok", "weworkremotely", "greenhouse", "lever", "ashby",
    "careerspage", "myjobmag", "brightermonday", "corporatestaffing", "fuzu",
)
WORKPLACE_TYPES = ("remote", "hybrid", "onsite", "unknown")
EXPERIENCE_LEVELS = (
    "internship", "entry", "junior", "mid", "senior", "lead", "principal", "executive", "unknown",
)

# Phrases that mark a listing as site chrome rather than a posting.
NOISE_PHRASES = (
    "advertise your job here", "upload your cv", "free cv review", "job alert",
    "subscribe to job alert", "sign in and apply", "log in and apply",
    "view all latest jobs today", "lorem ipsum",
)

# Job-type patterns, first match wins.
JOB_TYPES = (
    (r"\bfull[\s-]?time\b", "full-time"),
    (r"\bpart[\s-]?time\b", "part-time"),
    (r"\bintern(ship)?\b", "internship"),
    (r"\bcontract\b", "contract"),
    (r"\btemporary\b", "temporary"),
    (r"\bfreelance\b", "freelance"),
    (r"\bconsult(ing|ant)\b", "contract"),
    (r"\bvolunteer\b", "volunteer"),
)

# Seniority keywords (substring match), first level that hits wins.
EXPERIENCE_WORDS = (
    ("internship", ("internship", "intern", "graduate trainee")),
    ("entry", ("entry level", "entry-level", "entry", "no experience")),
    ("junior", ("junior", "associate")),
    ("mid", ("mid level", "mid-level", "intermediate")),
    ("senior", ("senior", "sr.")),
    ("lead", ("lead", "manager", "head of", "staff")),
    ("principal", ("principal", "architect")),
    ("executive", ("executive", "director", "vp", "vice president", "chief")),
)
# Upper bound in years for each level when only a duration is given.
YEARS_TO_LEVEL = ((1, "entry"), (3, "junior"), (5, "mid"), (8, "senior"))

# Workplace keywords (substring match), first type that hits wins.
WORKPLACE_WORDS = (
    ("remote", ("remote", "work from home", "home-based", "distributed", "worldwide")),
    ("hybrid", ("hybrid", "part remote", "flexible workplace")),
    ("onsite", ("onsite", "on-site", "office based", "office-based", "in office")),
)
VAGUE_PLACES = ("kenya", "uganda", "nigeria", "africa")

# City to country, country tokens, cities searched inside free text.
CITY_COUNTRY = {
    "nairobi": "Kenya", "mombasa": "Kenya", "kisumu": "Kenya", "nakuru": "Kenya",
    "eldoret": "Kenya", "kiambu": "Kenya", "kampala": "Uganda", "gulu": "Uganda",
    "lagos": "Nigeria", "abuja": "Nigeria", "accra": "Ghana", "london": "United Kingdom",
    "dublin": "Ireland", "new york": "USA", "nyc": "USA", "san francisco": "USA", "sf": "USA",
}
COUNTRY_TOKENS = (
    "kenya", "uganda", "nigeria", "ghana", "usa", "united states", "ireland", "united kingdom",
)
CITY_IN_TEXT = (
    "nairobi", "mombasa", "kisumu", "nakuru", "eldoret", "kampala", "gulu", "lagos", "abuja",
    "accra", "london", "dublin", "san francisco", "new york", "nyc", "sf",
)
CITY_SHORT_FORMS = {"nyc": "New York", "sf": "San Francisco"}
REMOTE_ONLY_PLACES = ("", "remote", "worldwide", "global")

# Skill name and the aliases searched in blank-padded lower-case text.
SKILLS = (
    ("python", ("python",)),
    ("fastapi", ("fastapi",)),
    ("django", ("django",)),
    ("flask", ("flask",)),
    ("javascript", ("javascript", " js ")),
    ("typescript", ("typescript",)),
    ("react", ("react", "react.js")),
    ("next.js", ("next.js", "nextjs")),
    ("node.js", ("node.js", " node ")),
    ("java", (" java ",)),
    ("kotlin", ("kotlin",)),
    ("swift", ("swift",)),
    ("golang", ("golang", " go ")),
    ("c#", ("c#", ".net", "asp.net")),
    ("sql", (" sql ", "postgres", "postgresql", "mysql", "sql server")),
    ("excel", ("excel", "microsoft excel")),
    ("powerpoint", ("powerpoint", "microsoft powerpoint")),
    ("word", ("microsoft word",)),
    ("machine learning", ("machine learning", " ml ")),
    ("data analysis", ("data analysis", "data analytics", "analyze data")),
    ("data visualization", ("data visualization", "visualization")),
    ("computer vision", ("computer vision",)),
    ("nlp", ("natural language processing", " nlp ")),
    ("aws", (" aws ", "amazon web services")),
    ("azure", (" azure ",)),
    ("gcp", (" gcp ", "google cloud")),
    ("docker", (" docker ",)),
    ("kubernetes", ("kubernetes", " k8s ")),
    ("terraform", ("terraform",)),
    ("devops", ("devops", "site reliability", " sre ")),
    ("git", (" git ",)),
    ("linux", (" linux ",)),
    ("customer service", ("customer service", "customer support")),
    ("billing", ("billing",)),
    ("collections", ("collections", "debt collection")),
    ("sales", (" sales ",)),
    ("marketing", ("marketing", "digital marketing")),
    ("project management", ("project management",)),
    ("account management", ("account management",)),
    ("recruitment", ("recruitment", "talent acquisition", "hiring")),
    ("communication", ("communication skills", "written communication", "verbal communication")),
    ("leadership", ("leadership", "team leadership")),
    ("compliance", ("compliance",)),
    ("quality assurance", ("quality assurance", " qa ")),
    ("customer experience", ("customer experience",)),
    ("office administration", ("office administration", "administration")),
    ("bookkeeping", ("bookkeeping",)),
)
SKILL_LEAD_INS = (
    "experience with", "experience in", "knowledge of", "proficiency in", "familiarity with",
)
FEED_TITLE_TAGS = ("python", "react", "javascript", "golang", "devops", "data")
FEED_JOB_LABELS = ("full-time", "contract", "internship", "part-time")

# Currency spellings and their codes.
CURRENCY_CODES = {
    "ksh": "KES", "kes": "KES", "$": "USD", "usd": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}

# Description headings and the section they open.
HEADINGS = {
    "description": "Overview", "job summary": "Overview", "about the job": "Overview",
    "responsibilities": "Responsibilities", "key responsibilities": "Responsibilities",
    "duties": "Responsibilities", "what you'll do": "Responsibilities",
    "requirements": "Requirements", "qualifications": "Requirements",
    "qualifications & requirements": "Requirements", "experience": "Requirements",
    "benefits": "Benefits", "what's on offer": "Benefits",
    "method of application": "Application",
}

# Query keys that identify a posting, in lookup order.
ID_QUERY_KEYS = ("gh_jid", "jid", "jobid", "job_id", "opening", "vacancy")

# Link texts that never lead to a posting.
BLOCKED_LINK_TEXTS = (
    "homepage", "search results", "view all latest jobs today", "back to home", "login", "sign up",
)
NEXT_PAGE_WORDS = ("next", "older", "go to next page")

# Operating limits.
MAX_PER_SOURCE = 25
MAX_RESULT_PAGES = 3
MAX_DETAILS_PER_PAGE = 40
RATE_LIMIT = 3
RATE_WINDOW_SECONDS = 60
COOLDOWN_SECONDS = 45

# Markers of the detail view.
REQUIREMENT_MARKERS = (
    "requirements", "qualifications", "what you bring", "about you", "who you are",
    "skills and experience",
)
RESPONSIBILITY_MARKERS = (
    "responsibilities", "what you'll do", "what you will do", "your responsibilities",
    "role responsibilities", "what your work will focus on",
)
POINT_HEADINGS = (
    "requirements", "qualifications", "responsibilities", "what you'll do", "what you will do",
    "what you bring", "about you", "who you are",
)
LEAD_HEADINGS = (
    "responsibilities", "requirements", "qualifications", "what you'll do", "what you will do",
    "what you bring", "about you", "who you are",
)
DETAIL_ROW_BUDGET = 20
DETAIL_TITLES = ("About the job", "Role responsibilities", "Requirements / qualifications")
DETAIL_EMPTY_TEXT = "No clean structured details were available for this listing."

# Columns of the CSV export, in order; True marks quoted text.
CSV_COLUMNS = (
    ("id", False), ("source_job_id", True), ("title", True), ("company", True),
    ("location", True), ("location_city", True), ("location_country", True),
    ("workplace_type", False), ("source", False), ("source_website", True),
    ("job_type", True), ("experience_level", False), ("salary_text", True),
    ("job_url", True), ("apply_url", True), ("posted_at", False), ("scraped_at", False),
    ("skills", True),
)

# CSS selectors tried for each field of a detail page, in order.
FIELD_SELECTORS = {
    "title": ("h1", "[data-testid*='title']", "[class*='job-title']", "[class*='posting-title']",
              "[class*='listing-title']"),
    "company": ("[data-testid*='company']", "[class*='company']", ".employer-name", "h2"),
    "location": ("[data-testid*='location']", "[class*='location']", "[class*='applicant-location']"),
    "job_type": ("[data-testid*='job-type']", "[class*='employment-type']", "[class*='job-type']",
                 "[class*='contract-type']"),
    "salary": ("[data-testid*='salary']", "[class*='salary']", "[class*='compensation']"),
    "posted_at": ("time", "[data-testid*='posted']", "[class*='posted']", "[class*='date']"),
    "experience": ("[data-testid*='experience']", "[class*='experience']", "[class*='seniority']"),
    "skills": ("[data-testid*='tag']", "[class*='tag']", "[class*='skill']"),
    "description": ("[data-testid*='description']", "[class*='job-description']",
                    "[class*='description']", "[class*='job-details']", "article", "main"),
}
