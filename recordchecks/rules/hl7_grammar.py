"""Structure of an ORU^R01 message as data: which segment may follow which.

Fixed values: the groups (a message holds PATIENT_RESULT groups, each of them
ORDER_OBSERVATION groups) and the order of segments in them.
"""

# --- fixed values -----------------------------------------------------------
MESSAGE_START = "message start"
PATIENT_GROUP, ORDER_GROUP = "ORU_R01.PATIENT_RESULT", "ORU_R01.ORDER_OBSERVATION"

# state (the last segment that moves the message on) -> segments that may come next
FOLLOWS = {
    MESSAGE_START: ["MSH"],
    "MSH": ["PID"],
    "PID": ["PV1", "ORC", "OBR", "NTE"],
    "PV1": ["ORC", "OBR"],
    "ORC": ["OBR"],
    "OBR": ["OBX", "NTE"],
    "OBX": ["OBX", "NTE", "ORC", "OBR", "PID"],
}
# states in which a message may end
MAY_END = ["OBX"]
# segment with a set id -> segments that start its numbering anew
NUMBERED = {"PID": [], "OBR": ["PID"], "OBX": ["PID", "OBR"]}
# a site's own segments may stand anywhere
SITE_PREFIX = "Z"
