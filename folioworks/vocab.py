"""Fixed values. Word lists, patterns, weights and thresholds that decide results."""

from __future__ import annotations

# --- calendar -------------------------------------------------------------------------------
MONTHS = [
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE",
    "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
]

# --- categorical vocabularies ---------------------------------------------------------------
RESULTS = [
    "PASSED", "QUALIFIED", "COMPARTMENTAL", "COMPARTMENTALLY", "A GRADE", "B GRADE", "C GRADE", "D GRADE",
    "FIRST DIVISION", "SECOND DIVISION", "THIRD DIVISION", "FAILED",
]
MEDIA = ["ENGLISH", "TELUGU", "URDU", "HINDI", "MARATHI", "KANNADA", "TAMIL", "ORIYA"]
TRUTH_MEDIA = MEDIA + ["ODIA"]
PAPERS = ["I", "II"]
DIGIT_WORDS = {
    "ZERO": "0", "ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5",
    "SIX": "6", "SEVEN": "7", "EIGHT": "8", "NINE": "9",
}
NUMBER_WORDS = DIGIT_WORDS | {"NIL": "0"}

# --- look-alike characters ------------------------------------------------------------------
LETTERS_AS_DIGITS = ("OQDUILTZSBG", "00001112586")
LETTERS_AS_DIGITS_CARD = ("OQDUILT|ZSBG", "000011112586")
DIGITS_AS_LETTERS = ("012586", "OIZSBG")
DIGITS_AS_LETTERS_CARD = ("0125864", "OIZSBGA")

# --- record layout --------------------------------------------------------------------------
TRUTH_KEYS = [
    "file", "document_type", "state", "board", "student_name", "father_name", "mother_name",
    "hall_ticket_number", "year_of_pass", "month_of_pass", "course", "group", "medium",
    "subjects", "total_marks", "maximum_marks", "percentage", "result", "cgpa",
]
REQUIRED_FOR_COVERAGE = [
    "state", "board", "student_name", "father_name", "mother_name", "hall_ticket_number",
    "year_of_pass", "month_of_pass", "medium", "total_marks", "result", "subjects",
]
NAME_FIELDS = ["student_name", "father_name", "mother_name"]
FLAT_KEYS = [
    "file", "document_type", "state", "board", "student_name", "father_name", "mother_name",
    "hall_ticket_number", "year_of_pass", "month_of_pass", "course", "group", "medium", "subjects",
    "total_marks", "maximum_marks", "percentage", "result", "cgpa", "notes",
]
NULL_WHEN_MISSING = ["year_of_pass", "total_marks", "maximum_marks", "percentage", "cgpa"]
CONFLICT_FIELDS = [
    "student_name", "father_name", "mother_name", "year_of_pass", "month_of_pass",
    "total_marks", "result", "medium",
]
REPORT_FIELDS = [
    "student_name", "father_name", "mother_name", "hall_ticket_number", "year_of_pass", "month_of_pass",
    "course", "group", "medium", "total_marks", "maximum_marks", "percentage", "result",
    "state", "board", "document_type", "cgpa",
]
TEXT_FIELDS = ["student_name", "father_name", "mother_name", "hall_ticket_number", "course"]
TARGET_DOCUMENT_TYPE = "Intermediate certificate"
CERTIFICATE = "intermediate_certificate"

# --- truth checks ---------------------------------------------------------------------------
NAME_TEMPLATE_WORDS = (
    r"(?i)\b(THIS|THISIS|CERTIFY|CERTY|CER|CEIY|CEVILY|THAT|THT|TAT|HA|NAME|FATHER|MOTHER)\b"
)
SHORT_NAME_ENDINGS = ["MD", "SK"]
TRUTH_YEARS = (1980, 2030)

# --- subject sets: first full match wins ----------------------------------------------------
SUBJECT_GROUPS = [
    ("MPC", ["MATHEMATICS", "PHYSICS", "CHEMISTRY"]),
    ("BIPC", ["BOTANY", "ZOOLOGY", "PHYSICS", "CHEMISTRY"]),
    ("MEC", ["MATHEMATICS", "ECONOMICS", "COMMERCE"]),
    ("CEC", ["CIVICS", "ECONOMICS", "COMMERCE"]),
    ("HEC", ["HISTORY", "ECONOMICS", "CIVICS"]),
]

# --- classification phrases -----------------------------------------------------------------
DOCUMENT_PHRASES = {
    "intermediate_certificate": [
        ("BOARD OF INTERMEDIATE EDUCATION", 3.0), ("INTERMEDIATE EDUCATION", 1.0),
        ("INTERMEDIATE PASS CERTIFICATE", 2.0), ("PASS CERTIFICATE CUM MEMORANDUM OF MARKS", 2.0),
        ("INTERMEDIATE PUBLIC EXAMINATION", 2.0), ("MEMORANDUM OF MARKS", 1.0), ("INTERMEDIATE", 1.0),
        ("OPEN SCHOOL SOCIETY", 1.0), ("VOCATIONAL COURSE", 0.5),
    ],
    "senior_school_certificate": [
        ("SENIOR SCHOOL CERTIFICATE", 4.0), ("CENTRAL BOARD OF SECONDARY EDUCATION", 3.0),
        ("ALL INDIA SENIOR SCHOOL CERTIFICATE EXAMINATION", 4.0),
        ("NATIONAL INSTITUTE OF OPEN SCHOOLING", 3.0),
    ],
    "secondary_school_certificate": [
        ("SECONDARY SCHOOL CERTIFICATE", 3.0), ("BOARD OF SECONDARY EDUCATION", 3.0), ("CLASS X", 1.0),
    ],
    "diploma": [
        ("STATE BOARD OF TECHNICAL EDUCATION", 4.0), ("DIPLOMA IN", 2.0), ("POLYTECHNIC", 1.0),
    ],
}
STATE_PHRASES = {
    "Telangana": [
        ("TELANGANA", 3.0), ("TELANGANA STATE BOARD OF INTERMEDIATE EDUCATION", 2.0),
        ("TELANGANA BOARD OF INTERMEDIATE EDUCATION", 2.0), ("TS B", 0.5),
    ],
    "Andhra Pradesh": [
        ("ANDHRA PRADESH", 3.0), ("BOARD OF INTERMEDIATE EDUCATION A P", 2.0),
        ("BIE AP GOV IN", 1.0), ("AMARAVATI", 1.0), ("VIJAYAWADA", 0.5),
    ],
}
PAGE_ROLE_PHRASES = {
    "certificate": [
        ("THIS IS TO CERTIFY THAT", 2.0), ("FATHER S NAME", 2.0), ("MOTHER S NAME", 2.0),
        ("FATHER NAME", 2.0), ("MOTHER NAME", 2.0), ("REGISTERED NO", 1.5), ("REGD NUMBER", 1.5),
        ("HALL TICKET NO", 1.5), ("TOTAL MARKS", 1.0), ("MARKS SECURED", 1.0), ("GRAND TOTAL", 1.0),
    ],
    "notes": [
        ("ELIGIBILITY RULES", 2.0), ("AWARDING OF GRADES", 2.0), ("EXPLANATORY NOTE", 2.0),
        ("RANGE OF MARKS PERCENTAGE", 2.0), ("A CANDIDATE IS DECLARED AS PASSED", 1.5),
        ("MINIMUM PASS MARKS", 1.0), ("DEAF DUMB", 1.0), ("NOTE", 0.3),
    ],
}
TS_STATE_BOARD = "Telangana State Board of Intermediate Education"
TS_BOARD = "Telangana Board of Intermediate Education"
TS_OPEN = "Telangana Open School Society"
AP_OPEN = "Andhra Pradesh Open School Society"
AP_BOARD = "Board of Intermediate Education, Andhra Pradesh"
AP_BOARD_SHORT = "Board of Intermediate Education, A.P."
CENTRAL_BOARD = "Central Board of Secondary Education"
BOARD_STATE = {
    TS_STATE_BOARD: "Telangana", TS_BOARD: "Telangana", TS_OPEN: "Telangana",
    AP_OPEN: "Andhra Pradesh", AP_BOARD: "Andhra Pradesh", AP_BOARD_SHORT: "Andhra Pradesh",
}
BOARD_IDS = {
    TS_STATE_BOARD: "TSBIE", TS_BOARD: "TSBIE", AP_BOARD: "BIEAP", AP_BOARD_SHORT: "BIEAP",
    AP_OPEN: "APOSS", TS_OPEN: "TOSS", CENTRAL_BOARD: "CBSE",
}

# --- certificate labels ---------------------------------------------------------------------
ANCHORS = {
    "STUDENT_NAME": ["This is to certify that", "certify that", "NAME", "Name of the Candidate"],
    "FATHER_NAME": ["Father's Name", "Father Name", "FATHER'S NAME"],
    "MOTHER_NAME": ["Mother's Name", "Mother Name", "MOTHER'S NAME"],
    "HALL_TICKET": ["Registered No", "REGD NUMBER", "Regd. No", "Hall Ticket No", "bearing Registered No"],
    "EXAM_SESSION": ["Examination held in", "held in", "MONTH & YEAR", "Held in", "in"],
    "RESULT": ["and passed in", "and passed", "passed in", "RESULT", "and passed with"],
    "MEDIUM": ["as the medium of instruction", "Medium of Instruction", "MEDIUM", "with"],
    "TOTAL_MARKS": ["Total Marks", "In Figures", "GRAND TOTAL", "TOTAL MARKS"],
    "TOTAL_IN_WORDS": ["In Words", "GRAND TOTAL :(in words)", "(in words)", "TOTAL MARKS"],
    "CGPA": ["CGPA", "passed with CGPA"],
}
TRUTH_FIELD_OF = {
    "STUDENT_NAME": ["student_name"], "FATHER_NAME": ["father_name"], "MOTHER_NAME": ["mother_name"],
    "HALL_TICKET": ["hall_ticket_number"], "EXAM_SESSION": ["month_of_pass", "year_of_pass"],
    "RESULT": ["result"], "MEDIUM": ["medium"], "TOTAL_MARKS": ["total_marks"],
    "TOTAL_IN_WORDS": ["total_marks"], "CGPA": ["cgpa"],
}
SCALAR_LABELS = list(ANCHORS)
TABLE_LABELS = ["SUBJECT", "MAX_MARKS", "MARKS"]
SINGLE_WORD_LABELS = ["MAX_MARKS", "MARKS", "TOTAL_MARKS", "HALL_TICKET", "CGPA"]
ROW_START_ANCHORS = ["IN", "WITH", "NAME"]
TEMPLATE_PHRASES = [
    "This is to certify that", "has appeared for the Intermediate Public Examination held",
    "has appeared at the Intermediate Public", "Examination held in", "and passed in", "and passed with",
    "and passed the Intermediate Public Examination held in", "as the medium of instruction",
    "was examined and the marks awarded are as follows", "The subjects in which", "Father's Name",
    "Mother's Name", "Registered No", "Total Marks", "In Figures", "In Words", "Maximum Marks",
    "Marks Secured", "Optional Subjects",
]
TABLE_HEADERS = ["Subject", "SUBJECT", "Maximum Marks", "Marks Secured", "Max Marks"]
TABLE_ENDS = ["Total Marks", "GRAND TOTAL", "TOTAL MARKS", "In Words", "CGPA"]
YEAR_HEADERS = {
    "I": ["I Year", "Ist YEAR", "1st YEAR", "FIRST YEAR", "IYear"],
    "II": ["II Year", "2nd YEAR", "IInd YEAR", "SECOND YEAR", "IIYear"],
}
PRACTICAL_MARKERS = ["PRACTICAL", "PRACTICALS"]
TYPICAL_MAXIMA = [20, 25, 30, 40, 50, 60, 75, 80, 100]
PLAUSIBLE_MAXIMA = [20, 25, 30, 40, 50, 60, 70, 75, 80, 100]
NON_SUBJECT_WORDS = [
    "PART", "OPTIONAL", "SUBJECTS", "SUBJECT", "ENVIRONMENTAL", "ETHICS", "YEAR", "MAX",
    "MARKS", "SECURED", "MAXIMUM", "GRADE", "POINT", "TOTAL",
]
YEAR_LABELS = {
    "PRACTICALS": "practicals", "PRACTICAL": "practicals", "IST": "year", "1ST": "year", "FIRST": "year",
    "2ND": "year", "IIND": "year", "SECOND": "year",
}

# --- review ---------------------------------------------------------------------------------
HIGH_CONFIDENCE = 0.90
MEDIUM_CONFIDENCE = 0.60
REQUIRED_FIELDS = [
    "student_name", "father_name", "mother_name", "hall_ticket_number", "year_of_pass", "total_marks", "result",
]
RECOMMENDED_FIELDS = ["board", "state"]
ACCEPT_SIMILARITY = 95.0
REVIEW_SIMILARITY = 80.0
SIGNATURE_BITS_APART = 10
NAME_SIMILARITY = 0.90
SPLIT_SEED = 20240917

# --- identity documents ---------------------------------------------------------------------
NAME_STOP_WORDS = [
    "GOVERNMENT", "INDIA", "AADHAAR", "AADHAR", "AUTHORITY", "UNIQUE", "IDENTIFICATION", "DOB",
    "MALE", "FEMALE", "ENROLMENT", "ENROLLMENT", "ADDRESS", "INCOME", "TAX", "DEPARTMENT", "GOVT",
    "PERMANENT", "ACCOUNT", "NUMBER", "CARD", "SIGNATURE", "NAME", "FATHER", "FATHERS", "BIRTH",
    "DATE", "VID", "ISSUE", "DOWNLOAD", "INFORMATION", "PROOF", "IDENTITY", "CITIZENSHIP",
    "MINOR", "YOUR", "VERIFIED", "VALID", "MOBILE", "HELP", "TO", "OF",
]
TAX_NUMBER = r"[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]"
TAX_HOLDER_TYPES = {
    "P": "individual", "C": "company", "H": "Hindu undivided family", "F": "firm",
    "A": "association of persons", "T": "trust", "B": "body of individuals",
    "L": "local authority", "J": "artificial juridical person", "G": "government",
}
TRAVEL_LABELS = {
    "type": ["Type"],
    "code": ["Code", "Country Code"],
    "nationality": ["Nationality"],
    "passport_number": ["Passport No", "Passport No.", "Passport Number"],
    "surname": ["Surname"],
    "given_names": ["Given Name(s)", "Given Names", "Given Name"],
    "sex": ["Sex"],
    "date_of_birth": ["Date of Birth"],
    "place_of_birth": ["Place of Birth"],
    "place_of_issue": ["Place of Issue"],
    "date_of_issue": ["Date of Issue"],
    "date_of_expiry": ["Date of Expiry"],
    "father_name": ["Name of Father / Legal Guardian", "Legal Guardian", "Name of Father"],
    "mother_name": ["Name of Mother"],
    "spouse_name": ["Name of Spouse"],
    "address": ["Address"],
    "old_passport": ["Old Passport No. with Date and Place of Issue", "Date and Place of Issue", "Old Passport No"],
    "file_number": ["File No", "File No.", "File Number"],
}
TRAVEL_FIELDS = [
    "passport_number", "surname", "given_names", "nationality", "sex", "date_of_birth", "place_of_birth",
    "place_of_issue", "date_of_issue", "date_of_expiry", "father_name", "mother_name", "spouse_name",
    "address", "file_number",
]
TRAVEL_REQUIRED = ["passport_number", "surname", "given_names", "date_of_birth", "date_of_expiry"]
TAX_CARD_LABELS = [
    ("father_name", "FATHER'S NAME"), ("father_name", "FATHERS NAME"), ("father_name", "FATHER NAME"),
    ("date_of_birth", "DATE OF BIRTH"), ("name", "NAME"),
]
GRADE_POINTS = {"A1": 10, "A2": 9, "B1": 8, "B2": 7, "C1": 6, "C2": 5, "D1": 4, "D2": 3, "D": 4}
MEMO_AREAS = [
    ("L1", "First language", r"FIRST\s*LANGUAGE"), ("L2", "Second language", r"SECOND\s*LANGUAGE"),
    ("L3", "Third language", r"THIRD\s*LANGUAGE"), ("MA", "Mathematics", r"MATHEMATICS"),
    ("SC", "Science", r"(?:GENERAL\s*)?SCIENCE"), ("SS", "Social studies", r"SOCIAL\s*STUDIES"),
]
MEMO_LABELS = {
    "student_name": r"CERTIFIED\s*THAT",
    "father_name": r"FATHER'?S?\s*NAME|FATHER\s*NAME",
    "mother_name": r"MOTHER'?S?\s*NAME|MOTHER\s*NAME",
    "roll_number": r"(?:BEARING\s*)?ROLL\s*NO\.?",
    "date_of_birth": r"DATE\s*OF\s*BIRTH(?:\s*OF\s*THE)?",
    "school": r"BELONG(?:ING|S)\s*TO|\bSCHOOL\b\s*:|^\W*SCHOOL\b",
    "medium": r"^\W*MEDIUM",
}
MEMO_REQUIRED = ["student_name", "date_of_birth", "roll_number"]
MEMO_AREA_SUBJECT = {"MA": "MATHEMATICS", "SC": "SCIENCE", "SS": "SOCIAL STUDIES"}
CHECK_WEIGHTS = [7, 3, 1]
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
