"""HL7 v2 ORU^R01 rule tables for the two validation profiles.

Fixed values: these lists, descriptions, patterns and message texts must
equal the rules being re-implemented for the findings to match, so they are
stated here plainly, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
STRICT_REQUIRED_SEGMENTS = ["MSH", "PID", "PV1", "ORC", "OBR", "OBX"]
LENIENT_REQUIRED_SEGMENTS = ["MSH"]
LENIENT_EXPECTED_SEGMENTS = ["PID", "PV1", "OBR", "OBX"]

MSH_REQUIRED = [
    (1, "Field Separator"),
    (2, "Encoding Characters"),
    (3, "Sending Application"),
    (4, "Sending Facility"),
    (5, "Receiving Application"),
    (6, "Receiving Facility"),
    (7, "DateTime of Message"),
    (9, "Message Type"),
    (10, "Message Control ID"),
    (11, "Processing ID"),
    (12, "Version ID"),
]
PID_REQUIRED = [(3, "Patient Identifier List"), (5, "Patient Name"),
                (7, "Date/Time of Birth"), (8, "Sex")]
PV1_REQUIRED = [(2, "Patient Class")]
OBR_REQUIRED = [(2, "Placer Order Number"), (3, "Filler Order Number"),
                (4, "Universal Service Identifier"), (7, "Observation Date/Time"),
                (25, "Result Status")]
OBX_REQUIRED = [(1, "Set ID"), (2, "Value Type"), (3, "Observation Identifier"),
                (5, "Observation Value"), (11, "Observation Result Status")]

# lenient profile: MSH fields recommended (warning when blank), in this order
LENIENT_MSH_RECOMMENDED = [9, 10, 7, 12]
LENIENT_PID_RECOMMENDED = [3, 5, 7, 8]
LENIENT_OBR_CRITICAL = [4, 7, 25]
LENIENT_OBX_CRITICAL = [2, 3, 5, 11]

STRICT_VERSIONS = ["2.3", "2.4", "2.5", "2.5.1", "2.6", "2.7", "2.8", "2.8.1", "2.8.2"]
LENIENT_VERSIONS = ["2.1", "2.2", "2.3", "2.3.1", "2.4", "2.5", "2.5.1", "2.6", "2.7"]
SEX_CODES = ["M", "F", "O", "U", "A", "N"]
PATIENT_CLASSES = ["I", "O", "E", "P", "R", "B", "C", "N", "U"]
ORDER_CONTROLS = ["NW", "OK", "UA", "CA", "OC", "CR", "UC", "DC", "HD", "HR"]
RESULT_STATUSES = ["O", "I", "S", "A", "P", "C", "R", "N", "D", "X", "Y", "Z"]
PRIORITIES = ["S", "A", "R", "P", "C", "T", "NULL"]
STRICT_VALUE_TYPES = ["ST", "TX", "FT", "NM", "SN", "DT", "TM", "TS", "IS", "CE", "CWE", "RP", "RP"]
LENIENT_VALUE_TYPES = ["ST", "TX", "FT", "NM", "SN", "DT", "TM", "TS", "IS", "CE", "CWE", "RP"]
OBX_STATUSES = ["F", "N", "D", "X", "C", "R", "S", "P", "A"]

EXPECTED_MESSAGE_TYPE = "ORU^R01"
TIMESTAMP_PATTERN = r"^\d{4}([01]\d[0-3]\d)([0-2]\d[0-5]\d([0-5]\d)?)?(\.\d+)?([+-]\d{4})?$"
STRICT_UNITS_PATTERN = r"^[A-Za-z0-9°%/\\.]+$"
LENIENT_UNITS_PATTERN = r"^[A-Za-z0-9°%/\\.\s]+$"
RANGE_PATTERNS = [r"^[\d\.]+\s*-\s*[\d\.]+$", r"^[<>]\s*[\d\.]+$"]
SEGMENT_SPLIT = "\r\n|\r|\n"
# batch / file envelope segments: not part of the message they wrap
ENVELOPE_SEGMENTS = ["FHS", "BHS", "BTS", "FTS"]

STRICT_PARSE_ERROR = "HL7 Validation Error: message does not start with an MSH segment"
LENIENT_PARSE_ERROR = "Message parsing failed: message does not start with an MSH segment"
# --- end of fixed values ----------------------------------------------------


def pylist(values) -> str:
    """A code list rendered the way the findings texts show it: ['A', 'B']."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Finding codes, grouped by the operator keys that select them.
CODE_GROUPS = {
    "structure": ["segment_missing", "segment_expected", "no_obx"],
    "required": ["required", "recommended", "critical"],
    "pid3": ["pid3_id"],
    "msg_type": ["msg_type"],
    "code_sets": ["code_set", "version"],
    "timestamps": ["ts_format", "ts_date"],
    "units": ["units"],
    "ref_range": ["ref_range"],
    "order_consistency": ["order_mismatch"],
    "obx3": ["obx3_component"],
    "parse": ["parse"],
}
