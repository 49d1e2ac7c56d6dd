"""Spellings of levels, employment types and work modes."""

# Experience spellings per level code.
EXPERIENCE_ALIASES = {
    "ENTRY_LEVEL": ["entry", "entry-level", "entry level", "junior", "jr", "intern", "internship", "assistant"],
    "MID_LEVEL": ["mid", "mid-level", "mid level", "intermediate", "mid-senior", "mid senior"],
    "SENIOR_LEVEL": ["senior", "senior-level", "senior level", "sr", "lead", "principal"],
    "EXECUTIVE_LEVEL": ["executive", "executive-level", "executive level", "director", "manager", "vp"],
}
LEVEL_NAMES = {
    "ENTRY_LEVEL": "Entry-level", "MID_LEVEL": "Mid-level",
    "SENIOR_LEVEL": "Senior", "EXECUTIVE_LEVEL": "Executive",
}

# Words that show a level, tested in this order.
LEVEL_WORDS = [
    ("Senior", ["senior", "sr.", "lead", "principal", "staff"]),
    ("Mid-level", ["mid", "intermediate", "experienced"]),
    ("Entry-level", ["junior", "jr.", "entry", "associate"]),
    ("Executive", ["executive", "director", "manager"]),
]

# Words that show an employment type, tested in this order as whole words.
EMPLOYMENT_WORDS = [
    ("Full-time", r"full[- ]?time|permanent|regular|ft"),
    ("Part-time", r"part[- ]?time|pt"),
    ("Contract", r"contract(?:or|ual|ing)?|consultant"),
    ("Internship", r"intern(?:ship)?|trainee|co-?op|student"),
    ("Temporary", r"temp(?:orary)?|seasonal|short[- ]term"),
    ("Freelance", r"freelance"),
]

# Employment spellings a search may use, and the type each one asks for.
EMPLOYMENT_ALIASES = {
    "Full-time": ["full-time", "full time", "fulltime"],
    "Part-time": ["part-time", "part time", "parttime"],
    "Contract": ["contract", "contractor", "freelance"],
    "Internship": ["internship", "intern", "trainee", "co-op", "coop", "student"],
    "Temporary": ["temporary", "temp"],
}

# Work-mode searches: (spellings, work mode, words in title or description).
WORK_MODES = [
    (["remote", "work from home", "wfh", "telecommute", "telework"], ["remote"],
     ["remote", "work from home", "wfh", "telecommute"]),
    (["hybrid", "partially remote", "part remote", "flexible"], ["hybrid"],
     ["hybrid", "partially remote", "flexible"]),
    (["onsite", "on-site", "on site", "office", "in-person", "in person"], ["on-site", "onsite"],
     ["onsite", "on-site", "office", "in-person"]),
]

# Job types, tested in this order.
JOB_TYPES = [("permanent", "Permanent"), ("temporary", "Temporary"), ("contract", "Contract")]

EXPERIENCE_ROWS = [(s, level) for level, names in EXPERIENCE_ALIASES.items() for s in names]
EMPLOYMENT_ROWS = [(s, kind) for kind, names in EMPLOYMENT_ALIASES.items() for s in names]
