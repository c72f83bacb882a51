"""Mapping from device-record JSON attributes to HL7 segments (the clinic's
mapping CSV), and the fixed segment texts of the generated messages.

Columns: SEGMENT, SEGMENT_ID, CHILD_OBR, JSON_ATTRIBUTE, HL7_KEY, IDENTIFIER,
DISPLAY_NAME, DATA_TYPE, UNIT, SEQUENCE (empty = 999)."""

MAPPING_SCHEMA = ("SEGMENT string, SEGMENT_ID string, CHILD_OBR string, JSON_ATTRIBUTE string, "
                  "HL7_KEY string, IDENTIFIER string, DISPLAY_NAME string, DATA_TYPE string, "
                  "UNIT string, SEQUENCE string")

DEFAULT_MAPPING = [
    ("PID", "", "", "Baxter Patient ID", "PID.3", "BAXTER_PATIENT_ID", "Baxter Patient ID", "CX", "", "1"),
    ("PID", "", "", "ERP Patient ID", "PID.3", "ERP_PATIENT_ID", "ERP Patient ID", "CX", "", "1"),
    ("PID", "", "", "Clinic Patient ID", "PID.3", "CLINIC_PATIENT_ID", "Clinic Patient ID", "CX", "", "2"),
    ("OBR", "", "", "Vitals", "OBR.4", "VITALS", "Vital Signs", "", "", "1"),
    ("OBR", "", "", "Actual Therapy", "OBR.4", "ACTUAL_THERAPY", "Actual Therapy Cycle", "", "", "2"),
    ("OBR", "", "", "Total Therapy", "OBR.4", "TOTAL_THERAPY", "Total Therapy", "", "", "3"),
    ("OBX", "", "Vitals", "Pre-Treatment.Weight", "OBX.5", "PRE_WEIGHT", "Pre-Treatment Weight", "NM", "kg", "1"),
    ("OBX", "", "Vitals", "Pre-Treatment.Blood Pressure Systolic", "OBX.5", "PRE_BP_SYS", "Pre-Treatment Systolic BP", "NM", "mmHg", "2"),
    ("OBX", "", "Vitals", "Pre-Treatment.Pulse", "OBX.5", "PRE_PULSE", "Pre-Treatment Pulse", "NM", "bpm", "3"),
    ("OBX", "", "Vitals", "Post-Treatment.Weight", "OBX.5", "POST_WEIGHT", "Post-Treatment Weight", "NM", "kg", ""),
    ("OBX", "", "Actual Therapy", "Therapy Cycle Time", "OBX.5", "CYCLE_TIME", "Therapy Cycle Time", "TM", "", "1"),
    ("OBX", "", "Actual Therapy", "Cycle Type", "OBX.5", "CYCLE_TYPE", "Cycle Type", "ST", "", "2"),
    ("OBX", "", "Actual Therapy", "Fill Volume", "OBX.5", "FILL_VOLUME", "Fill Volume", "NM", "mL", "3"),
    ("OBX", "", "Actual Therapy", "Fill Time", "OBX.5", "FILL_TIME", "Fill Time", "NM", "s", "4"),
    ("OBX", "", "Total Therapy", "Total Therapy Volume", "OBX.5", "TOTAL_VOLUME", "Total Therapy Volume", "NM", "mL", "1"),
]

# --- fixed values -----------------------------------------------------------
HL7_VERSION = "2.5"
APP_FIELDS = "SENDING_APP|SENDING_FACILITY|RECEIVING_APP|RECEIVING_FACILITY"
DEFAULT_BATCH_TYPE = "Normal"
DEFAULT_CLINIC = "XYZClinic"
BAXTER_ID_SUFFIX = "^^^Baxter_Patient_ID"
CLINIC_ID_SUFFIX = "^^^Clinic_Patient_ID"
VITALS_OBR = "VITAL_SIGNS^Vitals Panel^CLINIC_APP"
DEVICE_OBX = "DEVICE_TYPE^Device Type"
BTS_SEGMENT = "BTS|1|final segment|100"
# --- end of fixed values ----------------------------------------------------
