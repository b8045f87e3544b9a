"""Fixed values.

Everything in this file is a constant that results depend on: class names,
word lists, weights, thresholds, regular expressions and request wording.
Regular expressions are written in Python's dialect; ``functions.patterns``
turns them into the form Spark's regex functions need.
"""

# Class names, in rule order (the order decides every tie).
LABELS = ["Compliance", "Sleep", "Order", "Delivery", "Physician", "Prescription"]
UNKNOWN = "Unknown"

# Order in which a reply is searched for a class name.
LABEL_PRIORITY = ["Physician", "Prescription", "Delivery", "Sleep", "Compliance", "Order"]

# Rule families, their weight as a fraction, and thresholds.
FAMILY_WEIGHTS = {
    "keywords": (1, 1),
    "structure_starts": (3, 2),
    "measurements": (4, 5),
    "required_fields": (2, 1),
}
PATTERN_WEIGHT = 1.5
RULE_THRESHOLD = 0.4
PROTOTYPE_THRESHOLD = 0.3
REPLY_THRESHOLD = 0.5
FEW_SHOT_CONFIDENCE = 0.9

# The default rule set, class -> family -> features.
DEFAULT_RULES = {
    "Compliance": {
        "keywords": [
            "compliance", "usage", "period", "percentage", "met", "adherence", "therapy",
            "utilization", "average", "daily use", "pressure settings", "leak rate",
            "events per hour",
        ],
        "structure_starts": [
            "AirView", "Compliance Report", "Usage Summary", "Patient Compliance Data",
            "Therapy Report",
        ],
        "measurements": [
            "cmH2O", "L/min", "hours/night", "days/week", "%", "events/hour", "AHI",
        ],
        "required_fields": [
            "usage days", "compliance percentage", "average usage", "therapy hours",
            "pressure settings",
        ],
        "semantic_patterns": [
            r"\d+(\.\d+)?\s*hours?\s*(per|/)\s*(night|day)",
            r"\d+(\.\d+)?\s*%\s*compliance",
            r"used\s+([0-9]+)\s+out of\s+([0-9]+)\s+nights?",
        ],
    },
    "Sleep": {
        "keywords": [
            "sleep", "study", "apnea", "diagnostic", "polysomnography", "rem", "arousal",
            "hypopnea", "oxygen", "saturation",
        ],
        "structure_starts": [
            "MUSC", "MEDICAL UNIVERSITY", "Sleep Study Report", "Polysomnography Report",
            "Sleep Laboratory",
        ],
        "measurements": [
            "cm", "hours", "SpO2", "µV", "Hz", "dB", "events/hour", "breaths/min",
        ],
        "required_fields": [
            "sleep study report", "patient name", "apnea index", "study date",
            "total sleep time",
        ],
        "semantic_patterns": [
            r"AHI\s*[:<]?\s*\d+(\.\d+)?",
            r"Stage [N|R][1-3]:\s*\d+(\.\d+)?%",
            r"Sleep efficiency:\s*\d+(\.\d+)?%",
        ],
    },
    "Order": {
        "keywords": [
            "order", "equipment", "supply", "authorized", "prescribed", "requested",
            "purchase", "requisition", "authorization",
        ],
        "structure_starts": [
            "MRN", "Order Date", "Purchase Order", "Equipment Request", "Supply Order",
        ],
        "measurements": [],
        "required_fields": ["order", "MRN", "date", "provider", "equipment description"],
        "semantic_patterns": [
            r"Order\s*#?\s*\d+",
            r"MRN\s*#?\s*\d+",
            r"Date:\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
        ],
    },
    "Delivery": {
        "keywords": [
            "delivery", "receipt", "equipment", "supplied", "received", "shipment",
            "delivered", "confirmed", "acceptance",
        ],
        "structure_starts": [
            "DELIVERY RECEIPT", "Proof of Delivery", "Equipment Delivery",
            "Delivery Confirmation",
        ],
        "measurements": [],
        "required_fields": ["name", "equipment", "delivery date", "signature"],
        "semantic_patterns": [
            r"Delivered\s+on:\s+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
            r"Received\s+by:\s+[A-Za-z\s]+",
            r"Delivery\s+ID:\s*\w+",
        ],
    },
    "Physician": {
        "keywords": [
            "assessment", "diagnosis", "examination", "treatment", "evaluation", "plan",
            "symptoms", "findings",
        ],
        "structure_starts": [
            "Follow up:", "Physician's Notes", "Clinical Notes", "Medical Assessment",
            "Progress Notes",
        ],
        "measurements": ["mg", "kg", "cm", "mm Hg", "bpm"],
        "required_fields": ["patient name", "physician", "assessment", "date", "diagnosis"],
        "semantic_patterns": [
            r"Assessment:.*Plan:",
            r"Diagnosis:\s*[A-Z][\w\s]+",
            r"Dr\.\s+[A-Za-z\s,]+",
        ],
    },
    "Prescription": {
        "keywords": [
            "rx", "prescribed", "dosage", "prescription", "refill", "medication",
            "dispense", "pharmacy", "sig",
        ],
        "structure_starts": [
            "Rx:", "Prescription", "Medication Order", "Drug Order", "Script",
        ],
        "measurements": ["MG", "ML", "MCG", "G", "Units"],
        "required_fields": [
            "dosage", "prescription", "medication name", "quantity", "refills",
        ],
        "semantic_patterns": [
            r"Take\s+\d+\s+tablet\(s\)\s+\w+",
            r"Refills:\s*\d+",
            r"Disp:\s*#?\d+",
        ],
    },
}

# The smaller rule set of the unweighted scorer.
SIMPLE_RULES = {
    "Compliance": {
        "keywords": ["compliance", "usage", "period", "percentage", "met"],
        "structure_starts": ["AirView", "Compliance Report"],
        "measurements": ["cmH20", "L/min"],
        "required_fields": ["usage days", "compliance percentage"],
    },
    "Sleep": {
        "keywords": ["sleep", "study", "apnea", "diagnostic", "polysomnography"],
        "structure_starts": ["MUSC", "MEDICAL UNIVERSITY"],
        "measurements": ["cm", "hours"],
        "required_fields": ["sleep study report", "patient name", "apnea index"],
    },
    "Order": {
        "keywords": ["order", "equipment", "supply", "authorized"],
        "structure_starts": ["MRN", "order date"],
        "measurements": [],
        "required_fields": ["order", "MRN", "date"],
    },
    "Delivery": {
        "keywords": ["delivery", "receipt", "equipment", "supplied"],
        "structure_starts": ["DELIVERY RECEIPT"],
        "measurements": [],
        "required_fields": ["name", "equipment"],
    },
    "Physician": {
        "keywords": ["assessment", "diagnosis", "examination", "treatment"],
        "structure_starts": ["Follow up:", "Physician's notes"],
        "measurements": [],
        "required_fields": ["patient name", "physician", "assessment"],
    },
    "Prescription": {
        "keywords": ["rx", "prescribed", "dosage", "prescription"],
        "structure_starts": [],
        "measurements": ["MG"],
        "required_fields": ["dosage", "prescription"],
    },
}

# Corpus statistics.
CATEGORY_KEYWORDS = {
    "Compliance": ["compliance", "usage", "period", "percentage", "met"],
    "Sleep": ["sleep", "study", "apnea", "diagnostic", "polysomnography"],
    "Order": ["order", "prescribed", "supply", "equipment", "authorized"],
    "Delivery": ["delivery", "equipment", "receipt", "service", "supplied"],
    "Physician": ["assessment", "diagnosis", "examination", "prescribed", "treatment"],
    "Prescription": ["rx", "prescribed", "dosage", "prescription", "refill"],
}
MEDICAL_TERMS = [
    "patient", "diagnosis", "treatment", "prescription", "medication", "dosage",
    "symptoms", "examination", "assessment", "therapy",
]
PROFESSIONAL_TITLES = ["dr", "md", "do", "rn", "pa", "np", "pharmd"]

DATE_PATTERNS = [
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
]
NUMBER_PATTERN = r"\d+(?:\.\d+)?(?:\s*%)?"
PERCENTAGE_PATTERN = r"\d+(?:\.\d+)?\s*%"
FORM_FIELD_PATTERNS = [
    r"(?:Name|Date|ID|DOB|Phone|Fax):\s*\S+",
    r"(?:Address|Location|Facility):\s*\S+",
]
TIME_REFERENCE_PATTERNS = [
    r"\d{1,2}:\d{2}\s*(?:AM|PM)?",
    r"(?:hour|minute|day|week|month|year)s?",
    r"(?:morning|afternoon|evening|night)",
]
PATIENT_INFO_PATTERNS = [
    r"(?:patient|name|id):\s*\S+",
    r"(?:dob|date of birth):\s*\S+",
    r"(?:mrn|medical record):\s*\S+",
]
MEASUREMENT_PATTERNS = [
    r"\d+\s*(?:mg|ml|g|kg|cm|mm|in|ft|lb|oz)",
    r"\d+\s*(?:hours?|minutes?|days?|weeks?|months?)",
]

# The cleaning chain. Ten steps in this order; step 2 drops the whole
# words below, step 10 strips whitespace, the others replace a pattern.
NOISE_WORDS = ["oor", "e", "aye", "eee"]
CLEANING_PATTERNS = {
    1: [(r"[^\w\s:/.,%-]+", "")],
    3: [(r"\n+", "\n")],
    4: [(r"\s{2,}", " ")],
    5: [(r"(?<=[.,])(?=\S)", " ")],
    6: [(r"(Phone|Fax|Email):? [^\n]*\n", "")],
    7: [(r"\A[^\w]+", "")],
    8: [(r"(\d)(cmH20|L/min|%)", "$1 $2")],
    9: [(r"\s+([:,])", "$1"), (r"([:,])\s+", "$1 ")],
}
CLEANING_STEPS = 10

# Stages in the processing metadata.
STAGES = ["OCR", "Text Cleaning", "Classification"]

# Confidence words of the one-line reply format.
CONFIDENCE_WORDS = {"Low": 0.3, "Medium": 0.6, "High": 0.9}
CONFIDENCE_WORD_OTHER = 0.5

# Wording of the one-vs-rest instruction around a class description.
OVR_INSTRUCTION = (
    "Identify if the following document matches the description: ",
    ". Return only Yes/No and confidence in percentage format.",
)

# The reply to a batch request, which the reply parser reads.
BATCH_REPLY_FORMAT = "Document X - Class: [class] - Confidence: [Low, Medium, High]"

# Function words that a list of a label's terms leaves out by default.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does "
    "down during each few for from had has have he her here him his how i if in into is it its just me more most my no nor "
    "not of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up us very was we were what when where which while who why will with "
    "would you your"
).split()
