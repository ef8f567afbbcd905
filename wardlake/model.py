"""Data model: record mapping, table layouts and merge keys."""

from __future__ import annotations

from pyspark.sql import types as T

# Table -> ordered columns.
TABLES: dict[str, list[str]] = {
    "patient": ["PATID", "PATBD", "PATAGE", "PATSEX"],
    "mvt": ["PATID", "EVTID", "ELTID", "PATAGE", "PATSEX", "DATENT", "DATSORT", "SEJUF", "SEJUM"],
    "biol": [
        "PATID", "EVTID", "ELTID", "PRLVTDATE", "SEJUM", "SEJUF", "PNAME", "ANAME", "RNAME",
        "LOINC", "RESULT", "UNIT", "MINREF", "MAXREF", "VALIDADATE", "PATAGE", "PATSEX",
    ],
    "pharma": [
        "PATID", "EVTID", "ELTID", "PRES", "ALLSPELABEL", "ALLUCD13", "DATENT", "DATSORT",
        "DATPRES", "CAT", "SEJUM", "SEJUF", "UFPRO", "PATBD", "PATAGE", "PATSEX", "SRC",
    ],
    "doceds": [
        "PATID", "EVTID", "ELTID", "RECTXT", "RECFAMTXT", "RECDATE", "RECTYPE", "SEJUM",
        "SEJUF", "PATBD", "PATAGE", "PATSEX",
    ],
    "pmsi": [
        "PATID", "EVTID", "ELTID", "DALL", "DATENT", "DATSORT", "SEJDUR", "SEJUM", "SEJUF",
        "PATBD", "PATAGE", "PATSEX", "CODEACTES", "ACTES", "MODEENT", "MODESORT", "PMSISTATUT",
        "GHM", "SEVERITE", "SRC",
    ],
}

# Record type -> target table and column paths. Columns that are
# not listed have no path: they come from enrichment or stay null.
MAPPING: dict[str, dict] = {
    "Patient": {
        "table": "patient",
        "columns": {"PATID": "id", "PATBD": "birthDate", "PATSEX": "gender"},
    },
    "Encounter": {
        "table": "mvt",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "id",
            "ELTID": "location[0].location.reference",
            "DATENT": "period.start",
            "DATSORT": "period.end",
            "SEJUM": "serviceProvider.display",
            "SEJUF": "location[0].location.display",
        },
    },
    "Observation": {
        "table": "biol",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "PRLVTDATE": "effectiveDateTime",
            "PNAME": "code.text",
            "ANAME": "code.text",
            "RNAME": "code.coding[0].display",
            "LOINC": "code.coding[0].code",
            "RESULT": "valueQuantity.value",
            "UNIT": "valueQuantity.unit",
            "MINREF": "referenceRange[0].low.value",
            "MAXREF": "referenceRange[0].high.value",
            "VALIDADATE": "issued",
        },
    },
    "MedicationRequest": {
        "table": "pharma",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "DATPRES": "authoredOn",
            "PRES": "dosageInstruction[0].text",
            "ALLSPELABEL": "medicationCodeableConcept.text",
            "ALLUCD13": "medicationCodeableConcept.coding[0].code",
            "UFPRO": "performer.display",
            "CAT": "category[0].text",
            "SRC": "requester.display",
        },
    },
    "DiagnosticReport": {
        "table": "doceds",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "RECTXT": "presentedForm[0].data",
            "RECDATE": "effectiveDateTime",
            "RECTYPE": "category[0].coding[0].display",
        },
    },
    "DocumentReference": {
        "table": "doceds",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "context.encounter.reference",
            "ELTID": "id",
            "RECTYPE": "category[0].coding[0].display",
            "RECDATE": "date",
            "RECTXT": "content[0].data",
            "SEJUM": "custodian.display",
        },
    },
    "Composition": {
        "table": "doceds",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "RECTYPE": "type.text",
            "RECDATE": "date",
            "RECTXT": "text.div",
            "RECFAMTXT": "section[0].text.div",
        },
    },
    "Condition": {
        "table": "pmsi",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "DALL": "code.text",
            "GHM": "code.coding[0].code",
            "SEVERITE": "severity.text",
            "PMSISTATUT": "clinicalStatus.coding[0].code",
            "DATENT": "recordedDate",
        },
    },
    "Procedure": {
        "table": "pmsi",
        "columns": {
            "PATID": "subject.reference",
            "EVTID": "encounter.reference",
            "ELTID": "id",
            "CODEACTES": "code.coding[0].code",
            "ACTES": "code.text",
            "DATENT": "performedPeriod.start",
        },
    },
}

# Table -> columns whose combination identifies a row in a merge.
# "patient" is merged too, on its own key, so that patient filters find a table.
MERGE_KEYS: dict[str, list[str]] = {
    "patient": ["PATID"],
    "mvt": ["EVTID"],
    "biol": ["EVTID", "PNAME", "PRLVTDATE"],
    "pharma": ["EVTID", "ELTID"],
    "doceds": ["EVTID", "RECTYPE", "RECDATE", "RECTXT"],
    "pmsi": ["EVTID", "ELTID"],
}

# Tables that take patient and stay attributes, and the id columns.
FACT_TABLES = ["biol", "pharma", "doceds", "pmsi"]
ID_COLUMNS = ["PATID", "EVTID", "ELTID"]

_TYPES = {("patient", "PATAGE"): T.IntegerType(), ("pmsi", "SEJDUR"): T.LongType()}


def column_type(table: str, column: str) -> T.DataType:
    """Stored type of a column: text, but for the age and the length of stay."""
    return _TYPES.get((table, column), T.StringType())


def table_schema(table: str, tables: dict[str, list[str]] = TABLES) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(table, c)) for c in tables[table]])


def expected_columns(mapping: dict, tables: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Column lists per table: the declared ones, else the union of the mapped columns."""
    if tables:
        return tables
    found: dict[str, dict[str, None]] = {}
    for rule in mapping.values():
        found.setdefault(rule["table"], {}).update(dict.fromkeys(rule["columns"]))
    return {table: list(columns) for table, columns in found.items()}


def types_of_table(table: str, mapping: dict = MAPPING) -> list[str]:
    """Record types that feed a table, in mapping order."""
    return [t for t, rule in mapping.items() if rule["table"] == table]
