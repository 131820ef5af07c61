"""Code tables: which item codes make up which concept, and which values are plausible.

All tables are small and fixed in length, which is why joins against them may be broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession



class CodeRule(NamedTuple):
    """How one item code is read.

    A raw value is accepted when it lies between ``low`` and ``high``; a missing bound does not
    constrain.  ``low_open`` / ``high_open`` exclude the bound itself.  An accepted value is
    converted with ``(value - shift) / scale``.
    """

    code: int
    concept: str
    low: float | None = None
    high: float | None = None
    low_open: bool = True
    high_open: bool = True
    shift: float = 0.0
    scale: float = 1.0


# --- Fixed values: laboratory concepts, their codes and the largest accepted value ----------
LAB_CONCEPTS = [
    ("aniongap", [50868], 10000.0),
    ("albumin", [50862], 10.0),
    ("bands", [51144], 100.0),
    ("bicarbonate", [50882], 10000.0),
    ("bilirubin", [50885], 150.0),
    ("creatinine", [50912], 150.0),
    ("chloride", [50806, 50902], 10000.0),
    ("glucose", [50809, 50931], 10000.0),
    ("hematocrit", [50810, 51221], 100.0),
    ("hemoglobin", [50811, 51222], 50.0),
    ("lactate", [50813], 50.0),
    ("platelet", [51265], 10000.0),
    ("potassium", [50822, 50971], 30.0),
    ("ptt", [51275], 150.0),
    ("inr", [51237], 50.0),
    ("pt", [51274], 150.0),
    ("sodium", [50824, 50983], 200.0),
    ("bun", [51006], 300.0),
    ("wbc", [51300, 51301], 1000.0),
]

# --- Fixed values: vital-sign concepts, their codes and open bounds on the raw value --------
VITAL_CONCEPTS = [
    ("heartrate", [211, 220045], 0.0, 300.0),
    ("sysbp", [51, 442, 455, 6701, 220179, 220050], 0.0, 400.0),
    ("diasbp", [8368, 8440, 8441, 8555, 220180, 220051], 0.0, 300.0),
    ("meanbp", [456, 52, 6702, 443, 220052, 220181, 225312], 0.0, 300.0),
    ("resprate", [615, 618, 220210, 224690], 0.0, 70.0),
    ("tempc", [223762, 676], 10.0, 50.0),
    ("glucose", [807, 811, 1529, 3745, 3744, 225664, 220621, 226537], 0.0, None),
]
SPO2_CODES = [646, 220277]  # accepted in (0, 100]
FAHRENHEIT_CODES = [223761, 678]  # accepted in (70, 120), stored as (v - 32) / 1.8
VITAL_ORDER = ["heartrate", "sysbp", "diasbp", "meanbp", "resprate", "tempc", "spo2", "glucose"]

# --- Fixed values: renal-replacement and sedation sources -----------------------------------
DIALYSIS_ANY_VALUE_CODES = [152, 148, 149, 146, 147, 151, 150]
DIALYSIS_LINE_CODES = [229, 235, 241, 247, 253, 259, 265, 271]
DIALYSIS_LINE_VALUE = "Dialysis Line"
DIALYSIS_PROCEDURE_CODE = 582
DIALYSIS_PROCEDURE_VALUES = [
    "CAVH Start", "CAVH D/C", "CVVHD Start", "CVVHD D/C", "Hemodialysis st", "Hemodialysis end",
]
DIALYSIS_POSITIVE_CODES = [
    226118, 227357, 225725, 226499, 224154, 225810, 227639, 225183, 227438, 224191, 225806,
    225807, 228004, 228005, 228006, 224144, 224145, 224149, 224150, 224151, 224152, 224153,
    224404, 224406, 226457,
]
DIALYSIS_INPUT_CODES = [227536, 227525]
DIALYSIS_DATE_CODES = [225318, 225319, 225321, 225322, 225324]
DIALYSIS_PROCESS_CODES = [225441, 225802, 225803, 225805, 224270, 225809, 225955, 225436]
SEDATION_CODES = [221668, 221744, 225972, 225942, 222168]
REWRITTEN_ORDER = "Rewritten"

# --- Fixed values: spellings folded into one demographic group; others pass through ---------
RACE_GROUPS = {
    "ASIAN - ASIAN INDIAN": "ASIAN",
    "ASIAN - CHINESE": "ASIAN",
    "ASIAN - KOREAN": "ASIAN",
    "ASIAN - SOUTH EAST ASIAN": "ASIAN",
    "BLACK/AFRICAN AMERICAN": "BLACK",
    "BLACK/CARIBBEAN ISLAND": "BLACK",
    "BLACK/AFRICAN": "BLACK",
    "BLACK/CAPE VERDEAN": "BLACK",
    "HISPANIC OR LATINO": "HISPANIC/LATINO",
    "HISPANIC/LATINO - CENTRAL AMERICAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - COLUMBIAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - CUBAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - DOMINICAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - GUATEMALAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - HONDURAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - MEXICAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - PUERTO RICAN": "HISPANIC/LATINO",
    "HISPANIC/LATINO - SALVADORAN": "HISPANIC/LATINO",
    "WHITE - BRAZILIAN": "WHITE",
    "WHITE - EASTERN EUROPEAN": "WHITE",
    "WHITE - OTHER EUROPEAN": "WHITE",
    "WHITE - RUSSIAN": "WHITE",
    "UNABLE TO OBTAIN": "UNKNOWN",
    "PATIENT DECLINED TO ANSWER": "UNKNOWN",
    "OTHER": "UNKNOWN",
}

# --- Fixed values: stage labels 2 and 3 count as 1 ------------------------------------------
STAGE_RECODE = {2: 1, 3: 1}

# --- Fixed values: legacy column names and their current spelling ---------------------------
LEGACY_NAMES = {"patient_id": "stay_id", "检验日期": "charttime", "akistage": "aki_stage"}


def lab_rules() -> list[CodeRule]:
    return [
        CodeRule(code, concept, 0.0, high, low_open=True, high_open=False)
        for concept, codes, high in LAB_CONCEPTS
        for code in codes
    ]


def vital_rules() -> list[CodeRule]:
    rules = [
        CodeRule(code, concept, low, high)
        for concept, codes, low, high in VITAL_CONCEPTS
        for code in codes
    ]
    rules += [CodeRule(code, "spo2", 0.0, 100.0, high_open=False) for code in SPO2_CODES]
    rules += [
        CodeRule(code, "tempc", 70.0, 120.0, shift=32.0, scale=1.8) for code in FAHRENHEIT_CODES
    ]
    return rules


def concepts(rules: list[CodeRule]) -> list[str]:
    """Concept names in first-seen order."""
    return list(dict.fromkeys(rule.concept for rule in rules))


def dictionary_frame(spark: SparkSession, rules: list[CodeRule]) -> DataFrame:
    """The rules as a local relation; codes must be unique."""
    if len({rule.code for rule in rules}) != len(rules):
        raise ValueError("a code may appear in one rule only")
    schema = pa.schema(
        [
            ("code", pa.int64()), ("concept", pa.string()),
            ("low", pa.float64()), ("high", pa.float64()),
            ("low_open", pa.bool_()), ("high_open", pa.bool_()),
            ("shift", pa.float64()), ("scale", pa.float64()),
        ]
    )
    return spark.createDataFrame(pa.Table.from_pylist([r._asdict() for r in rules], schema=schema))
