"""The rule catalogue as data: one line per control.

Columns: catalogue, control, mode, rung, severity, roles, checks, minimum evidence.  Checks name the
signatures of ``facts.SIGNATURES`` that must all hold ("-": none); evidence is etype:class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shipped controls.
CONTROLS = """
eu-ai-act DAT-01 automated 2 medium both Q03 Decision:self_report ModelCall:any
eu-ai-act DAT-02 semi-automated 2 medium both Q03 Decision:self_report ModelCall:any
eu-ai-act DAT-03 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act DAT-04 manual 3 medium both - Decision:self_report
eu-ai-act DOC-01 automated 2 high both Q02 Decision:self_report
eu-ai-act DOC-02 automated 2 medium both Q04 Decision:self_report
eu-ai-act DOC-03 automated 2 medium both Q05 ToolCall:any Decision:self_report
eu-ai-act DOC-04 semi-automated 2 medium both Q02 Decision:self_report
eu-ai-act DOC-05 manual 3 medium both - Decision:self_report
eu-ai-act INC-01 automated 2 medium both Q10 Decision:self_report Outcome:any
eu-ai-act INC-02 automated 2 high deployer+provider Q11 Incident:any
eu-ai-act INC-03 automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act INC-04 automated 2 high both Q06 ToolCall:any Decision:self_report
eu-ai-act INT-01 automated 2 high both Q13 ToolCall:any
eu-ai-act INT-02 automated 2 high both Q14 DelegationIssued:enforcement_point
eu-ai-act INT-03 automated 2 high both Q06 ToolCall:any Decision:self_report
eu-ai-act INT-04 automated 2 high both Q12 ToolCall:any Decision:self_report
eu-ai-act OVS-01 automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act OVS-02 automated 2 high both Q15 Decision:self_report
eu-ai-act OVS-03 automated 2 high both Q08+Q16+Q17 ToolCall:enforcement_point Decision:self_report
eu-ai-act OVS-04 automated 2 high both Q08 ToolCall:any Decision:self_report
eu-ai-act OVS-05 automated 2 medium both Q09 Decision:self_report PolicyDecision:any
eu-ai-act OVS-06 automated 2 high both Q05 ToolCall:any Decision:self_report
eu-ai-act OVS-07 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act OVS-08 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act OVS-09 manual 3 medium both - Decision:self_report
eu-ai-act REC-01 automated 2 high both Q02 Decision:self_report
eu-ai-act REC-02 automated 2 medium both Q04 Decision:self_report
eu-ai-act REC-03 automated 2 medium both Q03 Decision:self_report ModelCall:any
eu-ai-act REC-04 automated 2 medium both Q02+Q04 Decision:any
eu-ai-act REC-05 automated 2 medium both Q09 Decision:self_report PolicyDecision:any
eu-ai-act REC-06 automated 2 high both Q06 ToolCall:any Decision:self_report
eu-ai-act ROB-01 automated 2 high both Q12 ToolCall:any Decision:self_report
eu-ai-act ROB-02 automated 2 medium both Q03 Decision:self_report ModelCall:any
eu-ai-act ROB-03 automated 2 medium both Q06 ToolCall:any Decision:self_report
eu-ai-act ROB-04 automated 2 high both Q08 ToolCall:any Decision:self_report
eu-ai-act ROB-05 semi-automated 2 medium both Q05 ToolCall:any Decision:self_report
eu-ai-act ROB-06 semi-automated 2 medium both Q05 ToolCall:any Decision:self_report
eu-ai-act ROB-07 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act RSK-01 automated 2 medium both Q09 Decision:self_report PolicyDecision:any
eu-ai-act RSK-02 automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act RSK-03 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
eu-ai-act RSK-04 manual 3 medium both - Decision:self_report
eu-ai-act RSK-05 manual 3 medium both - Decision:self_report
eu-ai-act TRN-01 automated 2 medium both Q07 Decision:self_report Notice:any
eu-ai-act TRN-02 automated 2 high both Q02 Decision:self_report
eu-ai-act TRN-03 semi-automated 2 medium both Q07 Decision:self_report Notice:any
eu-ai-act TRN-04 automated 2 medium both Q04 Decision:self_report
eu-ai-act TRN-05 semi-automated 2 medium both Q07 Decision:self_report Notice:any
nist-ai-rmf INC-01 automated 2 medium both Q10 Decision:self_report Outcome:any
nist-ai-rmf INC-02 automated 2 high deployer+provider Q11 Incident:any
nist-ai-rmf OVS-08 semi-automated 2 medium both Q01 Decision:self_report ApprovalDecided:any
nist-ai-rmf REC-04 automated 2 medium both Q02+Q04 Decision:any
nist-ai-rmf ROB-02 automated 2 medium both Q03 Decision:self_report ModelCall:any
nist-ai-rmf TRN-03 semi-automated 2 medium both Q07 Decision:self_report Notice:any
conduct CND-01 automated 2 high deployer+provider Q18 ToolCall:enforcement_point
conduct CND-02 automated 2 high deployer+provider Q01 ToolCall:enforcement_point
conduct CND-03 semi-automated 3 medium deployer+provider - ToolCall:enforcement_point
conduct CND-04 automated 2 high deployer+provider Q19 ToolCall:enforcement_point
conduct CND-05 automated 2 high deployer+provider Q20 ToolCall:enforcement_point
conduct CND-06 automated 2 medium deployer+provider Q21 ToolCall:enforcement_point
conduct CND-07 automated 2 medium deployer+provider Q22 ToolCall:enforcement_point
conduct CND-08 semi-automated 3 high deployer+provider - ToolCall:enforcement_point
employment EMP-01 manual 3 high deployer+provider - Decision:independent_system
finance FIN-01 manual 3 high deployer+provider - Decision:independent_system
insurance INS-01 manual 3 high deployer+provider - Decision:independent_system
org-template ORG-01 manual 3 medium deployer+provider - Decision:independent_system
"""

#: How severe a finding is.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}
#: The six outcomes, in report order.
OUTCOMES = ["conformant", "non-conformant", "partial", "not_applicable", "not_assessed", "insufficient_evidence"]


def control_rows() -> list[dict]:
    rows = []
    for line in CONTROLS.strip().splitlines():
        catalog, control, mode, rung, severity, roles, checks, *need = line.split()
        # any and self_report are met by every class; other classes by equality
        keys = sorted({e if c in ("any", "self_report") else f"{e}:{c}" for e, c in (n.split(":") for n in need)})
        roles = ["deployer", "provider"] if "both" in roles.split("+") else sorted(roles.split("+"))
        rows.append({"catalog": catalog, "control": control, "mode": mode, "rung": int(rung), "severity": severity, "roles": roles, "checks": None if checks == "-" else checks, "need": keys})
    return rows


def controls(spark: SparkSession) -> DataFrame:
    """Control table; its size is that of the rule files, so it may be broadcast."""
    schema = "catalog string, control string, mode string, rung int, severity string, roles array<string>, checks string, need array<string>"
    rows = [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in control_rows()]
    return spark.createDataFrame(rows, schema).withColumn("tolerance", F.lit(0)).coalesce(1)
