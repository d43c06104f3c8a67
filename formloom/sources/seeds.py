"""Seed dictionary for use where no knowledge base can be read.

Fixed values of the public data standard, written as text: code|name|class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = """
DM|Demographics|Special Purpose
CO|Comments|Special Purpose
SE|Subject Elements|Special Purpose
SV|Subject Visits|Special Purpose
CM|Concomitant/Prior Medications|Interventions
EC|Exposure as Collected|Interventions
EX|Exposure|Interventions
SU|Substance Use|Interventions
PR|Procedures|Interventions
AE|Adverse Events|Events
CE|Clinical Events|Events
DS|Disposition|Events
DV|Protocol Deviations|Events
HO|Healthcare Encounters|Events
MH|Medical History|Events
DA|Drug Accountability|Findings
DD|Death Details|Findings
EG|ECG Test Results|Findings
IE|Inclusion/Exclusion Criteria|Findings
LB|Laboratory Test Results|Findings
PE|Physical Examination|Findings
QS|Questionnaires|Findings
SC|Subject Characteristics|Findings
VS|Vital Signs|Findings
FA|Findings About|Findings About
SR|Skin Response|Findings About
TA|Trial Arms|Trial Design
TD|Trial Disease Assessments|Trial Design
TE|Trial Elements|Trial Design
TI|Trial Inclusion/Exclusion Criteria|Trial Design
TM|Trial Disease Milestones|Trial Design
TS|Trial Summary|Trial Design
TV|Trial Visits|Trial Design
RELREC|Related Records|Relationship
RELSUB|Related Subjects|Relationship
RELSPEC|Related Specimens|Relationship
SUPPQUAL|Supplemental Qualifiers|Relationship
"""
IDENTIFIERS = """
STUDYID|Study Identifier
DOMAIN|Domain Abbreviation
USUBJID|Unique Subject Identifier
SUBJID|Subject Identifier
"""
TERMS = """
C66731|Sex|F|Female|C16576
C66731|Sex|M|Male|C20197
C66731|Sex|U|Unknown|C17998
C66731|Sex|UNDIFFERENTIATED|Undifferentiated|C45908
C66741|Vital Signs Test Code|SYSBP|Systolic Blood Pressure|C25298
C66741|Vital Signs Test Code|DIABP|Diastolic Blood Pressure|C25299
C66741|Vital Signs Test Code|PULSE|Pulse Rate|C49676
C66741|Vital Signs Test Code|TEMP|Temperature|C25206
C66741|Vital Signs Test Code|RESP|Respiratory Rate|C49677
C66741|Vital Signs Test Code|HEIGHT|Height|C25347
C66741|Vital Signs Test Code|WEIGHT|Weight|C25208
C66767|Action Taken with Study Treatment|DOSE NOT CHANGED|Dose Not Changed|C48660
C66767|Action Taken with Study Treatment|DOSE REDUCED|Dose Reduced|C49503
C66767|Action Taken with Study Treatment|DRUG INTERRUPTED|Drug Interrupted|C49502
C66767|Action Taken with Study Treatment|DRUG WITHDRAWN|Drug Withdrawn|C49501
C66767|Action Taken with Study Treatment|NOT APPLICABLE|Not Applicable|C48660
C66768|Outcome of Adverse Event|RECOVERED/RESOLVED|Recovered/Resolved|C49494
C66768|Outcome of Adverse Event|RECOVERING/RESOLVING|Recovering/Resolving|C49495
C66768|Outcome of Adverse Event|NOT RECOVERED/NOT RESOLVED|Not Recovered/Not Resolved|C49496
C66768|Outcome of Adverse Event|RECOVERED/RESOLVED WITH SEQUELAE|Recovered/Resolved with Sequelae|C49497
C66768|Outcome of Adverse Event|FATAL|Fatal|C48275
C66768|Outcome of Adverse Event|UNKNOWN|Unknown|C17998
C66769|Severity|MILD|Mild|C70666
C66769|Severity|MODERATE|Moderate|C70667
C66769|Severity|SEVERE|Severe|C70668
NY|No Yes Response|N|No|C49488
NY|No Yes Response|Y|Yes|C49487
"""
#: Ends of variable names and the codelist they point to.
SUFFIX_CODELISTS = """
UNIT|C66770
ROUTE|C66729
FREQ|C66728
POSITION|C71148
SEV|C66769
ACN|C66767
REL|C66766
OUT|C66768
"""


def rows(text: str) -> list[tuple[str, ...]]:
    return [tuple(line.split("|")) for line in text.strip().splitlines()]


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(DOMAINS), "code string, name string, class string")


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(TERMS), "codelist_code string, codelist_name string, submission_value string, preferred_term string, term_code string")


def identifier_variables(spark: SparkSession) -> DataFrame:
    """The identifiers of every seed domain: the fixed product of two small tables."""
    ids = spark.createDataFrame(rows(IDENTIFIERS), "name string, label string")
    return domains(spark).select(F.col("code").alias("domain")).crossJoin(F.broadcast(ids)).withColumn("role", F.lit("Identifier"))


def codelist_of(variable: F.Column) -> F.Column:
    """The codelist of the longest known end of a variable name; null if none fits."""
    out = None
    for suffix, code in sorted(rows(SUFFIX_CODELISTS), key=lambda r: (-len(r[0]), r[0])):
        hit = variable.endswith(suffix)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out
