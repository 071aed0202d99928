"""Encounter rows turned into versioned nodes, edges and tombstones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import present
from ..schema import NAMESPACES, InvalidRequest
from .graph import persisted
from .ranks import global_rank

# fixed values: columns of an encounter row
DIAGNOSES = ("diag_1", "diag_2", "diag_3")
ASSAYS = ("max_glu_serum", "A1Cresult")
DEMOGRAPHICS = ("race", "gender", "age", "weight")
STAY = ("admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital", "number_diagnoses", "num_medications", "num_lab_procedures", "num_procedures", "readmitted")
TAKEN = ("Steady", "Up", "Down")


def with_time(rows: DataFrame, base: int, step: int) -> DataFrame:
    """Encounter order becomes time: base + rank * step. Ranks come from counts of ranges, then ranks in them."""
    return global_rank(rows, ["encounter_id"], "_rank").withColumn("ts", F.lit(base) + F.col("_rank") * F.lit(step)).drop("_rank")


def first_patients(rows: DataFrame, n: int) -> DataFrame:
    """Encounters of the n patients admitted first; time is assigned before."""
    first = rows.groupBy("patient_nbr").agg(F.min("encounter_id").alias("_first"))
    return rows.join(first.orderBy("_first").limit(n), "patient_nbr").drop("_first")


def diagnosis_edges(rows: DataFrame) -> DataFrame:
    """(patient, encounter, code, place) for each present diagnosis."""
    long = rows.select("patient_nbr", "encounter_id", "ts", F.posexplode(F.array(*DIAGNOSES)).alias("place", "code"))
    return long.where(present(F.col("code")))


def prescription_edges(rows: DataFrame, drugs: list[str]) -> DataFrame:
    """(patient, encounter, drug) for each drug column with a dose."""
    long = rows.select("patient_nbr", "encounter_id", "ts", F.explode(F.array(*[F.struct(F.lit(d).alias("drug"), F.col(d).alias("dose")) for d in drugs])).alias("x"))
    return long.select("patient_nbr", "encounter_id", "ts", "x.drug", "x.dose").where(F.col("dose").isin(*TAKEN))


def lab_edges(rows: DataFrame, assays: tuple[str, ...] = ASSAYS) -> DataFrame:
    """(patient, encounter, assay=result) for each result that is there."""
    parts = [rows.select("patient_nbr", "encounter_id", "ts", F.concat(F.lit(f"{a}="), a).alias("lab")).where(present(F.col(a))) for a in assays]
    return reduce(DataFrame.unionByName, parts)


def provider_edges(rows: DataFrame) -> DataFrame:
    return rows.select("patient_nbr", "encounter_id", "ts", "medical_specialty").where(present(F.col("medical_specialty")))


def stopped_drugs(prescriptions: DataFrame, encounters: DataFrame) -> DataFrame:
    """Drugs of a patient's previous encounter that the next one no longer has: a tombstone at that one."""
    per = encounters.select("patient_nbr", "encounter_id", "ts").join(prescriptions.groupBy("encounter_id").agg(F.sort_array(F.collect_set("drug")).alias("drugs")), "encounter_id", "left")
    per = per.withColumn("drugs", F.coalesce("drugs", F.array().cast("array<string>")))
    w = Window.partitionBy("patient_nbr").orderBy("ts")
    return per.withColumn("gone", F.array_except(F.lag("drugs").over(w), F.col("drugs"))).select("patient_nbr", "encounter_id", "ts", F.explode("gone").alias("drug"))


def dense_ids(values: DataFrame, column: str, order: str, namespace: str, room: int = 100_000) -> DataFrame:
    """(column, id): ids of a namespace by first sight; more values than the namespace holds raise."""
    first = values.groupBy(column).agg(F.min(order).alias("_o"))
    ranked = global_rank(first, ["_o", column], "_rank")
    if namespace != "Encounter" and ranked.count() > room:
        raise InvalidRequest(f"namespace {namespace} overflows")
    return ranked.select(column, (F.lit(NAMESPACES[namespace]).cast("long") + F.col("_rank")).alias("id"))


def _told(*columns: str) -> Column:
    """JSON of the columns that are present."""
    return F.to_json(F.struct(*[F.when(present(F.col(c).cast("string")), F.col(c)).alias(c) for c in columns])) if columns else F.lit("{}")


def emit(rows: DataFrame, drugs: list[str], base: int, step: int, patients: int | None = None, room: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Versioned nodes and edges of encounter rows.

    Time comes from encounter order before ``patients`` (the number admitted first) are chosen. An encounter
    gives an edge from its patient to itself, to each present diagnosis, its specialty, its laboratory
    results and its drugs with a dose, then tombstones, by name, for drugs of the patient's previous
    encounter that it lacks; each gets the next microsecond. Conditions, providers, results and drugs are
    nodes at ``base``, patients at their first encounter with their demographics (and the names of those to
    be encrypted). Ids are dense by first sight; a namespace with more than its ``room`` raises, one that ``room``
    leaves out (``{}``: all) has no end. An empty table raises.
    Returns (node_id, ts, node_type, properties, encrypted) and (src, edge_type, dst, ts, properties, deleted).
    """
    timed = with_time(rows, base, step)
    if patients is not None:
        timed = first_patients(timed, patients)
    timed = timed.withColumns({"_patient": F.col("patient_nbr").cast("string"), "_encounter": F.col("encounter_id").cast("string")})
    if timed.isEmpty():
        raise InvalidRequest("no encounters to load")
    w = Window.partitionBy("patient_nbr").orderBy("ts")

    def item(kind: int, node_type: str, key: Column, properties: Column, deleted: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("edge_type"), F.lit(node_type).alias("node_type"), key.cast("string").alias("key"), properties.alias("properties"), F.lit(deleted).alias("deleted"))

    at = F.col("_encounter").alias("encounter_id")
    plain = F.to_json(F.struct(at))
    items = [item(6, "Encounter", F.col("_encounter"), F.lit("{}"))]
    items += [F.when(present(F.col(c)), item(1, "Condition", F.col(c), F.to_json(F.struct(F.lit(c).alias("position"), at)))) for c in DIAGNOSES]
    items.append(F.when(present(F.col("medical_specialty")), item(4, "Provider", F.col("medical_specialty"), plain)))
    items += [F.when(present(F.col(c)), item(5, "LabResult", F.concat(F.lit(f"{c}="), c), plain)) for c in ASSAYS]
    items += [F.when(F.col(c).isin(*TAKEN), item(2, "Medication", F.lit(c), F.to_json(F.struct(F.col(c).alias("status"), at)))) for c in drugs]
    now = F.filter(F.array(*[F.when(F.col(c).isin(*TAKEN), F.lit(c)) for c in drugs]).cast("array<string>"), lambda x: x.isNotNull())
    timed = timed.withColumn("_now", now).withColumn("_gone", F.array_sort(F.array_except(F.coalesce(F.lag("_now").over(w), F.array().cast("array<string>")), F.col("_now"))))
    gone = F.transform("_gone", lambda x: item(2, "Medication", x, F.lit(None).cast("string"), True))
    told = timed.select("_patient", "ts", F.posexplode(F.concat(F.filter(F.array(*items), lambda x: x.isNotNull()), gone)).alias("_place", "x"))
    told = persisted(told.select("_patient", (F.col("ts") + F.col("_place") + 1).alias("ts"), "x.*"), "emitted")

    seen = told.groupBy("node_type", "key").agg(F.min("ts").alias("first"))
    seen = seen.union(timed.groupBy(F.lit("Patient"), "_patient").agg(F.min("ts")))
    ranked = persisted(global_rank(seen, ["node_type", "first", "key"], "_rank"), "seen")
    begins = ranked.groupBy("node_type").agg(F.min("_rank").alias("_begin"), F.count(F.lit(1)).alias("_n")).collect()  # six rows at most
    if room is None:
        room = {t: 99_999 if t == "Patient" else 100_000 for t in NAMESPACES if t != "Encounter"}
    for r in begins:
        if r["_n"] > room.get(r["node_type"], r["_n"]):
            raise InvalidRequest(f"namespace {r['node_type']} overflows")
    offset = F.create_map(*[F.lit(v) for r in begins for v in (r["node_type"], NAMESPACES[r["node_type"]] - r["_begin"])])
    ids = persisted(ranked.select("node_type", "key", (F.col("_rank") + offset[F.col("node_type")]).cast("long").alias("node_id")), "ids")

    people = ids.where("node_type = 'Patient'").select(F.col("key").alias("_patient"), F.col("node_id").alias("src"))
    edges = told.join(ids.withColumnRenamed("node_id", "dst"), ["node_type", "key"]).join(people, "_patient").select("src", "edge_type", "dst", "ts", "properties", "deleted")

    none = F.array().cast("array<string>")
    who = [c for c in DEMOGRAPHICS if c in rows.columns]
    named = F.array_sort(F.filter(F.array(*[F.when(present(F.col(c)), F.lit(c)) for c in who]).cast("array<string>"), lambda x: x.isNotNull())) if who else none
    first = timed.select("_patient", "ts", _told(*who).alias("properties"), named.alias("encrypted"))
    first = first.groupBy("_patient").agg(F.min("ts").alias("ts"), F.min_by(F.struct("properties", "encrypted"), F.col("ts")).alias("x"))
    nodes = first.select(F.lit("Patient").alias("node_type"), F.col("_patient").alias("key"), "ts", "x.properties", "x.encrypted")
    nodes = nodes.union(timed.select(F.lit("Encounter"), "_encounter", "ts", _told(*[c for c in STAY if c in rows.columns]), none))
    part = F.split("key", "=", 2)
    shared = F.when(F.col("node_type") == "Condition", F.to_json(F.struct(F.col("key").alias("icd9_code")))).when(F.col("node_type") == "Provider", F.to_json(F.struct(F.col("key").alias("specialty"), F.lit("specialty_proxy").alias("identity"))))
    shared = shared.when(F.col("node_type") == "LabResult", F.to_json(F.struct(part[0].alias("assay"), part[1].alias("result")))).otherwise(F.to_json(F.struct(F.col("key").alias("drug"))))
    nodes = nodes.union(ids.where("node_type not in ('Patient', 'Encounter')").select("node_type", "key", F.lit(base).cast("long"), shared, none))
    return nodes.join(ids, ["node_type", "key"]).select("node_id", "ts", "node_type", "properties", "encrypted"), edges
