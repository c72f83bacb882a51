"""Import every query module so the registry is complete."""

from recordchecks.plans import basics_q, config_q, gen_q, hl7_q, jobs_q, json_q, recur_q, schema_q  # noqa: F401
from recordchecks.plans.registry import ORACLES, QUERIES  # noqa: F401
