"""Rule table for the JSON document checks, and the fixed texts.

Fixed values: the required rule columns, type names, time formats, the
value-range table, the watched optional fields, the extreme-value bounds and
the message texts must equal the rules being re-implemented, so they are
stated plainly here, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
REQUIRED_COLUMNS = ["CUSTOMER_ID", "CUSTOMER_NAME", "DEVICE", "SOURCE",
                    "JSON_ATTRIBUTE_NAME", "EXTRACT_QRY_COLUMN", "DATATYPE",
                    "JSON_ATTRIBUTE_NULLABILITY", "TS_FORMAT", "LENGTH"]
RULES_SCHEMA = ("CUSTOMER_ID INT, CUSTOMER_NAME STRING, DEVICE STRING, SOURCE STRING, "
                "JSON_ATTRIBUTE_NAME STRING, EXTRACT_QRY_COLUMN STRING, DATATYPE STRING, "
                "JSON_ATTRIBUTE_NULLABILITY STRING, TS_FORMAT STRING, LENGTH INT")

# TS_FORMAT name -> Spark datetime pattern; any other name tries all four
TS_FORMATS = {"DD-MON-YYYY": "d-MMM-yyyy", "HH:MM": "H:m", "HH:MM:SS": "H:m:s"}
FALLBACK_FORMATS = ["d-MMM-yyyy", "H:m", "H:m:s", "yyyy-M-d"]

# shape of a string each pattern can parse; checked first so that hopeless
# strings never reach the (exception-driven) datetime parser
FORMAT_SHAPES = {"d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "H:m": r"^\d{1,2}:\d{1,2}$",
                 "H:m:s": r"^\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$"}
# times of day, decided by their shape alone: the parser makes an exception of each that is wrong
TIME_SHAPES = {"H:m": r"^([01]?\d|2[0-3]):[0-5]?\d$", "H:m:s": r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"}

MSG_REQUIRED = "Required field is missing or empty"
MSG_TS_NOT_STRING = "Timestamp value must be string"

# (keyword in path, lower bound, lower bound open, upper bound, integer only,
#  only when the JSON value is a string, message)
RANGE_RULES = [
    ("Blood Pressure", 0, True, 300, True, True, "Blood pressure value out of reasonable range (1-300)"),
    ("Weight", 0, True, 1000, False, False, "Weight value out of reasonable range (1-1000 kg)"),
    ("Pulse", 0, True, 250, True, True, "Pulse value out of reasonable range (1-250 bpm)"),
    ("Temperature", 90, False, 110, False, True, "Temperature value out of reasonable range (90-110°F)"),
    ("Glucose", 0, True, 1000, True, True, "Glucose value out of reasonable range (1-1000 mg/dL)"),
]

OPTIONAL_MEDICAL_FIELDS = [
    "Vitals.Pre-Treatment.Weight", "Vitals.Post-Treatment.Weight",
    "Vitals.Pre-Treatment.Blood Pressure Systolic",
    "Vitals.Post-Treatment.Blood Pressure Systolic",
]
EXTREME_CHECKS = [
    ("Vitals.Pre-Treatment.Weight", 30, 300),
    ("Vitals.Post-Treatment.Weight", 30, 300),
    ("Vitals.Pre-Treatment.Blood Pressure Systolic", 70, 200),
    ("Vitals.Post-Treatment.Blood Pressure Systolic", 70, 200),
]
# --- end of fixed values ----------------------------------------------------

# Whole-string number tests shared by the type and range checks.
INT_PATTERN = r"^\s*[+-]?\d+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# The rule table used by the registered queries: the clinic's configuration
# (a CSV in production, loaded with ``operators.json_rules.load_rules``).
DEFAULT_RULES = [
    (1, "Clinic One", "BOTH", "TREATMENT", "Patient Info.ERP Patient ID", "erp_patient_id", "STRING", "N", None, 14),
    (1, "Clinic One", "BOTH", "TREATMENT", "Patient Info.Treatment ID", "treatment_id", "INTEGER", "N", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Patient Info.Last Name", "last_name", "STRING", "N", None, 9),
    (1, "Clinic One", "BOTH", "TREATMENT", "Patient Info.DOB", "dob", "STRING", "N", "DD-MON-YYYY", None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Patient Info.Middle Name", "middle_name", "STRING", "Y", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Batch.Date", "batch_date", "STRING", "N", "DD-MON-YYYY", None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Batch.Time", "batch_time", "STRING", "N", "HH:MM", None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Batch.Type", "batch_type", "STRING", "Y", "YYYY-MM-DD", None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Weight", "pre_weight", "NUMBER", "N", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Blood Pressure Systolic", "pre_bp_sys", "INTEGER", "Y", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Pulse", "pre_pulse", "INTEGER", "Y", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Temperature", "pre_temp", "NUMBER", "Y", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Pre-Treatment.Glucose", "pre_glucose", "INTEGER", "Y", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Vitals.Post-Treatment.Weight", "post_weight", "STRING", "N", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Actual Therapy[0].Cycle Type", "first_cycle_type", "STRING", "N", None, 5),
    (1, "Clinic One", "BOTH", "TREATMENT", "Actual Therapy[3].Cycle Type", "fourth_cycle_type", "STRING", "N", None, None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Actual Therapy[*].Therapy Cycle Time", "cycle_time", "STRING", "N", "HH:MM:SS", None),
    (1, "Clinic One", "BOTH", "TREATMENT", "Actual Therapy[*].CycleAttributes.Fill Volume", "fill_volume", "INTEGER", "N", None, None),
    (1, "Clinic One", "AMIA", "TREATMENT", "Patient Info.Device Type", "device_type", "STRING", "N", None, None),
    (1, "Clinic One", "CLARIA", "TREATMENT", "Total Therapy.Total Therapy Volume", "total_volume", "DECIMAL", "N", None, None),
    (2, "Clinic Two", "BOTH", "TREATMENT", "Patient Info.Clinic Patient ID", "clinic_patient_id", "INTEGER", "N", None, None),
    (1, "Clinic One", "BOTH", "CYCLE", "Actual Therapy[*].Cycle Type", "cycle_type", "STRING", "N", None, None),
]
