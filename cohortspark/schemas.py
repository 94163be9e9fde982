"""Types and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Concept ids, tokens and units of the source data.
FEMALE, MALE = 8532, 8507
HISPANIC, NOT_HISPANIC = 38003563, 38003564
WHITE, BLACK, ASIAN = 8527, 8516, 8515
ADMISSION_VISITS = (9201, 262)
TRUE_TOKENS = ("TRUE", "1", "1.0", "YES", "T")
FALSE_TOKENS = ("FALSE", "0", "0.0", "NO", "F")
SKIPPED_TOKENS = ("CENSORED", "CENSOR", "NAN", "NA", "NONE", "")
MINUTES_PER_DAY = 1440.0
UNBOUNDED_DAYS = 36500
DEFAULT_WINDOWS = (2, 7, 30, 365)
LAB_AGGREGATES = ("last", "min", "max", "mean", "n", "days_since")
AGE_BANDS = ((0, 40), (40, 55), (55, 65), (65, 75), (75, 85), (85, 200))
SPLITS = ("train", "valid", "test")

OMOP = {
    "measurement": "person_id long, measurement_concept_id long, measurement_date date, measurement_datetime timestamp, value_as_number double",
    "condition_occurrence": "person_id long, condition_concept_id long, condition_start_date date, condition_start_datetime timestamp",
    "drug_exposure": "person_id long, drug_concept_id long, drug_exposure_start_date date, drug_exposure_start_datetime timestamp",
    "procedure_occurrence": "person_id long, procedure_concept_id long, procedure_date date, procedure_datetime timestamp",
    "observation": "person_id long, observation_concept_id long, observation_date date, observation_datetime timestamp, value_as_number double",
    "visit_occurrence": "visit_occurrence_id long, person_id long, visit_concept_id long, visit_start_date date, visit_end_date date",
    "concept": "concept_id long, vocabulary_id string, concept_code string, concept_name string, domain_id string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int",
    "person": "person_id long, birth_datetime timestamp, year_of_birth int, gender_concept_id long, race_concept_id long, ethnicity_concept_id long, care_site_id long",
}

PREDICTIONS = "model string, task string, patient_id long, time timestamp, label double, prob double"


def omop_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(OMOP[table])
