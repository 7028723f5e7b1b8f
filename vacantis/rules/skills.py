"""Skill dictionary: canonical name → aliases, and related skills."""

# ---------------------------------------------------------------------------
# Results depend on these exact names and aliases.
# ---------------------------------------------------------------------------

SKILL_ALIASES = {
    "python": ["python", "python3", "py"],
    "javascript": ["javascript", "js", "ecmascript", "es6", "es2015"],
    "typescript": ["typescript", "ts"],
    "java": ["java"],
    "golang": ["golang", "go lang", "go-lang"],
    "rust": ["rust", "rustlang"],
    "c++": ["c++", "cpp", "c plus plus"],
    "c#": ["c#", "csharp", "c-sharp", ".net"],
    "ruby": ["ruby"],
    "php": ["php"],
    "swift": ["swift"],
    "kotlin": ["kotlin"],
    "scala": ["scala"],
    "r": ["r"],
    "sql": ["sql", "mysql", "postgresql", "postgres", "mssql", "sqlite"],
    "react": ["react", "reactjs", "react.js"],
    "vue": ["vue", "vuejs", "vue.js"],
    "angular": ["angular", "angularjs"],
    "svelte": ["svelte", "sveltekit"],
    "nextjs": ["next.js", "nextjs", "next js"],
    "nuxt": ["nuxt", "nuxtjs"],
    "html": ["html", "html5"],
    "css": ["css", "css3", "scss", "sass", "less"],
    "tailwind": ["tailwind", "tailwindcss"],
    "nodejs": ["node.js", "nodejs", "node js"],
    "django": ["django"],
    "flask": ["flask"],
    "fastapi": ["fastapi", "fast api"],
    "express": ["express", "expressjs"],
    "rails": ["rails", "ruby on rails"],
    "spring": ["spring", "spring boot", "springboot"],
    "graphql": ["graphql", "graph ql"],
    "rest": ["rest", "restful", "rest api"],
    "aws": ["aws", "amazon web services"],
    "gcp": ["gcp", "google cloud", "google cloud platform"],
    "azure": ["azure", "microsoft azure"],
    "kubernetes": ["kubernetes", "k8s"],
    "docker": ["docker", "containers"],
    "terraform": ["terraform"],
    "ansible": ["ansible"],
    "jenkins": ["jenkins"],
    "circleci": ["circleci", "circle ci"],
    "github actions": ["github actions", "gh actions"],
    "postgresql": ["postgresql", "postgres", "psql"],
    "mysql": ["mysql"],
    "mongodb": ["mongodb", "mongo"],
    "redis": ["redis"],
    "elasticsearch": ["elasticsearch", "elastic"],
    "dynamodb": ["dynamodb", "dynamo"],
    "cassandra": ["cassandra"],
    "neo4j": ["neo4j"],
    "pandas": ["pandas"],
    "numpy": ["numpy"],
    "pytorch": ["pytorch", "torch"],
    "tensorflow": ["tensorflow", "tf"],
    "scikit-learn": ["scikit-learn", "sklearn"],
    "spark": ["spark", "apache spark", "pyspark"],
    "kafka": ["kafka", "apache kafka"],
    "airflow": ["airflow", "apache airflow"],
    "dbt": ["dbt"],
    "git": ["git", "github", "gitlab", "bitbucket"],
    "agile": ["agile", "scrum", "kanban"],
    "ci/cd": ["ci/cd", "cicd", "continuous integration", "continuous deployment"],
    "tdd": ["tdd", "test driven development"],
    "microservices": ["microservices", "micro-services"],
    "api design": ["api design", "api development"],
    "linux": ["linux", "unix"],
}

SKILL_RELATIONS = {
    "react": ["javascript", "typescript", "nextjs", "html", "css"],
    "vue": ["javascript", "typescript", "nuxt", "html", "css"],
    "angular": ["typescript", "html", "css"],
    "python": ["django", "flask", "fastapi", "pandas", "numpy"],
    "java": ["spring", "maven", "gradle"],
    "nodejs": ["javascript", "typescript", "express"],
    "kubernetes": ["docker", "aws", "gcp", "azure"],
    "aws": ["terraform", "docker", "kubernetes"],
    "postgresql": ["sql"],
    "mongodb": ["nodejs"],
    "pytorch": ["python", "numpy"],
    "tensorflow": ["python", "numpy"],
}
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
