"""Statement texts for device job statuses.

Fixed values: the status names and the statement wording (D24: the
failure + partial-success text names the failed device as failed; the rest
is worded as in the rules being re-implemented)."""

# --- fixed values -----------------------------------------------------------
STATUSES = ["SUCCESS", "FAILURE", "PARTIAL_SUCCESS"]
DEVICES = ["AMIA", "CLARIA"]

STATEMENTS = {
    "STATEMENT_SUCCESS": "Job execution completed successfully. Status of job given below.",
    "STATEMENT_FAILED": "Job execution has failed. Status of job given below.",
    "STATEMENT_PARTIAL_SUCCESS": "Job execution has partially completed. Status of job given below.",
    "STATEMENT_SUCCESS_AND_FAILURE": "Job execution failed for {failure_device} device and completed successfully for {success_device} device. Current job status details:",
    "STATEMENT_FAILURE_AND_PARTIAL_SUCCESS": "Job execution partial success for {partial_device} device and failed for {failure_device} device. Current job status details:",
    "STATEMENT_SUCCESS_AND_PARTIAL_SUCCESS": "Job execution partial success for {partial_device} device and completed successfully for {success_device} device. Current job status details:",
    "STATEMENT_REPROCESS_SUCCESS": "Reprocessing resolved previous issues - now job is successful.",
    "STATEMENT_REPROCESS_FAILED": "Critical: Reprocessing failed to resolve job issues.",
    "STATEMENT_REPROCESS_PARTIAL_SUCCESS": "Unfortunately, Reprocessing did not fully resolve issues - job partially completed.",
    "STATEMENT_REPROCESS_SUCCESS_AND_FAILURE": "Unfortunately, Reprocessing did not fully resolve issues - for {failure_device} device job issues.",
    "STATEMENT_REPROCESS_FAILURE_AND_PARTIAL_SUCCESS": "Unfortunately, Reprocessing did not fully resolve issues - for {failed_device} device job issues.",
    "STATEMENT_REPROCESS_SUCCESS_AND_PARTIAL_SUCCESS": "Unfortunately, Reprocessing did not fully resolve issues - for {success_device} device job issues.",
}
REPORT_TITLE = "BATCH JOB STATUS REPORT"
# --- end of fixed values ----------------------------------------------------


def _initial(a: str, c: str) -> tuple[str, str]:
    """Statement key and text for one (AMIA, CLARIA) pair, no reprocess."""
    S, F_, P = STATUSES
    if a == c:
        key = {S: "STATEMENT_SUCCESS", F_: "STATEMENT_FAILED", P: "STATEMENT_PARTIAL_SUCCESS"}[a]
        return key, STATEMENTS[key]
    dev = {a: "AMIA", c: "CLARIA"}
    pair = {a, c}
    if pair == {S, F_}:
        key = "STATEMENT_SUCCESS_AND_FAILURE"
        return key, STATEMENTS[key].format(failure_device=dev[F_], success_device=dev[S])
    if pair == {F_, P}:
        key = "STATEMENT_FAILURE_AND_PARTIAL_SUCCESS"
        return key, STATEMENTS[key].format(partial_device=dev[P], failure_device=dev[F_])
    key = "STATEMENT_SUCCESS_AND_PARTIAL_SUCCESS"
    return key, STATEMENTS[key].format(partial_device=dev[P], success_device=dev[S])


def _reprocess(a: str, c: str) -> tuple[str, str]:
    S, F_, P = STATUSES
    if a == c:
        key = {S: "STATEMENT_REPROCESS_SUCCESS", F_: "STATEMENT_REPROCESS_FAILED",
               P: "STATEMENT_REPROCESS_PARTIAL_SUCCESS"}[a]
        return key, STATEMENTS[key]
    dev = {a: "AMIA", c: "CLARIA"}
    pair = {a, c}
    if pair == {S, F_}:
        key = "STATEMENT_REPROCESS_SUCCESS_AND_FAILURE"
        return key, STATEMENTS[key].format(failure_device=dev[F_])
    if pair == {F_, P}:
        key = "STATEMENT_REPROCESS_FAILURE_AND_PARTIAL_SUCCESS"
        return key, STATEMENTS[key].format(failed_device=dev[F_])
    key = "STATEMENT_REPROCESS_SUCCESS_AND_PARTIAL_SUCCESS"
    return key, STATEMENTS[key].format(success_device=dev[S])


def statement_rows() -> list[tuple]:
    """(is_reprocess, amia, claria, key, text): 2 x 9 rows, a bounded table."""
    out = []
    for a in STATUSES:
        for c in STATUSES:
            out.append((False, a, c) + _initial(a, c))
            out.append((True, a, c) + _reprocess(a, c))
    return out
