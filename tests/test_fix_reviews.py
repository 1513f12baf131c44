"""Decisions on the fixes of one diagnosis."""

from tidemark.operators import mining


def test_a_diagnosis_follows_the_latest_decision(spark):
    fixes = spark.createDataFrame([("fix-9", "d", "applied"), ("fix-10", "d", "pending_approval")], "fix_id string, diagnosis_id string, status string")
    diagnoses = spark.createDataFrame([("d", "fixing")], "diagnosis_id string, status string")

    def state(*decisions):
        told = spark.createDataFrame(list(decisions), "fix_id string, decision string, reason string, ts int")
        after, found = mining.review_fixes(fixes, diagnoses, told)
        return {r.fix_id: r.status for r in after.collect()}, found.first().status

    undo, approve = ("fix-9", "roll_back", ""), ("fix-10", "approve", "")
    both = {"fix-9": "rolled_back", "fix-10": "applied"}
    assert state((*undo, 1), (*approve, 2)) == (both, "fixed")
    assert state((*undo, 2), (*approve, 1)) == (both, "open")
