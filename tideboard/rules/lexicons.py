"""Skills, benefits, industries and the words that mark requirements."""

# Skill terms with their display form, in priority order.
SKILLS = [
    ("python", "Python"), ("javascript", "Javascript"), ("java", "Java"),
    ("typescript", "Typescript"), ("react", "React"), ("angular", "Angular"),
    ("vue", "Vue"), ("node.js", "Node.Js"), ("django", "Django"), ("flask", "Flask"),
    ("spring", "Spring"), ("express", "Express"), ("mongodb", "Mongodb"),
    ("postgresql", "Postgresql"), ("mysql", "Mysql"), ("redis", "Redis"),
    ("docker", "Docker"), ("kubernetes", "Kubernetes"), ("aws", "Aws"), ("azure", "Azure"),
    ("gcp", "Gcp"), ("git", "Git"), ("jenkins", "Jenkins"), ("ci/cd", "Ci/Cd"),
    ("rest api", "Rest Api"), ("graphql", "Graphql"), ("microservices", "Microservices"),
    ("php", "Php"), ("ruby", "Ruby"), ("go", "Go"), ("rust", "Rust"), ("c++", "C++"),
    ("c#", "C#"), ("swift", "Swift"), ("kotlin", "Kotlin"), ("scala", "Scala"), ("r", "R"),
    ("sql", "Sql"), ("elasticsearch", "Elasticsearch"), ("linux", "Linux"), ("unix", "Unix"),
    ("html", "Html"), ("css", "Css"), ("sass", "Sass"), ("less", "Less"),
    ("webpack", "Webpack"), ("babel", "Babel"), ("npm", "Npm"), ("yarn", "Yarn"),
    ("maven", "Maven"), ("gradle", "Gradle"), ("machine learning", "Machine Learning"),
    ("ai", "Ai"), ("artificial intelligence", "Artificial Intelligence"),
    ("data science", "Data Science"), ("analytics", "Analytics"),
    ("blockchain", "Blockchain"), ("cryptocurrency", "Cryptocurrency"),
    ("devops", "Devops"), ("agile", "Agile"), ("scrum", "Scrum"), ("kanban", "Kanban"),
]

# The skill terms that the card feed looks for.
CARD_SKILL_TERMS = [
    "python", "javascript", "java", "react", "angular", "vue", "node.js",
    "django", "flask", "spring", "express", "mongodb", "postgresql",
    "mysql", "redis", "docker", "kubernetes", "aws", "azure", "gcp",
    "git", "jenkins", "ci/cd", "rest api", "graphql", "microservices",
]
CARD_SKILLS = [(term, shown) for term, shown in SKILLS if term in CARD_SKILL_TERMS]

# Benefit terms with their display form, in priority order.
BENEFITS = [
    ("health insurance", "Health Insurance"), ("dental", "Dental"), ("vision", "Vision"),
    ("401k", "401K"), ("retirement", "Retirement"), ("vacation", "Vacation"), ("pto", "Pto"),
    ("paid time off", "Paid Time Off"), ("flexible schedule", "Flexible Schedule"),
    ("remote work", "Remote Work"), ("work from home", "Work From Home"),
    ("stock options", "Stock Options"), ("bonus", "Bonus"),
    ("professional development", "Professional Development"), ("training", "Training"),
    ("gym membership", "Gym Membership"),
]

# Industry terms with their display form, in priority order.
INDUSTRIES = [
    ("technology", "Technology"), ("healthcare", "Healthcare"), ("finance", "Finance"),
    ("education", "Education"), ("retail", "Retail"), ("manufacturing", "Manufacturing"),
    ("consulting", "Consulting"), ("nonprofit", "Nonprofit"), ("government", "Government"),
    ("media", "Media"), ("entertainment", "Entertainment"), ("real estate", "Real Estate"),
    ("automotive", "Automotive"),
]

# Words that mark a list item as a benefit.
BENEFIT_ITEM_WORDS = [
    "health", "dental", "vision", "insurance", "pto", "vacation", "sick", "leave",
    "retirement", "401k", "pension", "bonus", "stock", "equity", "remote", "flexible",
    "gym", "fitness", "lunch", "snacks", "coffee", "parking", "transit", "tuition",
    "education", "training", "development", "conference", "travel", "relocation",
]

# Words that mark a list item as a requirement.
REQUIREMENT_ITEM_WORDS = [
    "required", "must have", "minimum", "years of experience", "degree", "bachelor",
    "master", "phd", "certification", "license", "skills", "proficiency", "knowledge",
    "experience with", "familiar with", "understanding of", "ability to", "strong",
]

# Headings after which a text lists its requirements.
REQUIREMENT_HEADINGS = ["requirements", "qualifications", "you have", "what you bring"]

# Array limits of a posting.
MAX_SKILLS, MAX_REQUIREMENTS, MAX_BENEFITS = 10, 5, 8

# Integer codes of the card feed and the value for an unknown code.
CARD_WORK_MODES = {1: "On-site", 2: "Hybrid", 3: "Remote", 4: "Remote"}
CARD_WORK_MODE_DEFAULT = "On-site"
CARD_EMPLOYMENT = {1: "Full-time", 2: "Part-time", 3: "Contract", 4: "Internship", 5: "Temporary"}
CARD_EMPLOYMENT_DEFAULT = "Full-time"
CARD_BENEFITS = {
    1: "Health Insurance", 2: "Dental", 3: "Vision", 4: "401k",
    5: "Retirement", 6: "Vacation", 7: "PTO", 8: "Flexible Schedule",
}
