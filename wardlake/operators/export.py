"""From table rows to records, and from records to transaction bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake import model
from wardlake.functions import ids, records, values
from wardlake.session import stored

# Status that a record type gets, and the intent of prescriptions.
STATUS = {
    "Encounter": "finished",
    "Observation": "final",
    "MedicationRequest": "active",
    "DiagnosticReport": "final",
    "DocumentReference": "current",
    "Procedure": "completed",
}
INTENT = {"MedicationRequest": "order"}

# Parts of a path that mark a date.
DATE_MARKS = ["Date", "DateTime", "recorded", "period"]

# Table column -> record type that its reference paths point at.
REFERENCE_TYPES = {"PATID": "Patient", "EVTID": "Encounter", "ELTID": "Location"}

# Fixed value: name of a stub, before its id.
STUB_NAME = "Auto-generated Location "
STUB_ORD = -1

# Place of the line that ends a document: behind all entries.
TAIL_ORD = 1 << 30
# Records of a bundle above which it is dealt to several tasks and looked at for copies: of a record with so many, one per task
# is found before the shuffle.
MANY_COPIES = 100_000
# Records that a task of an export sorts.
SORTED_ROWS = 1_000_000

# Columns of a table of records, as the operators below pass them on.
RECORD_COLUMNS = ["patient_id", "stay_id", "ord", "type", "id", "location_id", "resource"]


def resource_defaults(record_type: str) -> dict[str, str]:
    """Literal fields of a record type."""
    fields = {"resourceType": record_type}
    if record_type in STATUS:
        fields["status"] = STATUS[record_type]
    if record_type in INTENT:
        fields["intent"] = INTENT[record_type]
    return fields


def reference_type(column: str, path: str) -> str | None:
    """Record type that a reference path points at: it follows the column, or a Location in the path."""
    return REFERENCE_TYPES.get(column) or ("Location" if "Location" in path else None)


def build_reference(value: Column, column: str, path: str) -> Column:
    """``Type/id`` for a reference path."""
    target = reference_type(column, path)
    if target is None:
        return value
    return F.concat(F.lit(f"{target}/"), ids.fallback_id(value))


def coerce_value(record_type: str, path: str, column: str, dtype: T.DataType = T.StringType()) -> Column:
    """Value to write at a path: sex code, date, id and reference have their rules, the rest goes as it is."""
    value = F.col(column)
    if record_type == "Patient" and path == "gender":
        return F.when(value.isNotNull(), values.gender_out(value))
    if any(mark in path for mark in DATE_MARKS):
        return values.fhir_date(value, dtype)
    if path == "id":
        return ids.fallback_id(value)
    if path.endswith(".reference"):
        return build_reference(value, column, path)
    return value


def set_paths(leaves: list[tuple[str, str]], fields: dict[str, str] | None = None) -> str:
    """SQL of one struct with a value (SQL) at each path. Null values create nothing, not even empty containers.

    Where two paths are the same, the later non-null value wins. Items before the last filled index of an
    array are empty objects. ``fields`` are literal texts that come first.
    """
    tree: dict = {}
    for path, value in leaves:
        node = tree
        steps = records.path_steps(path)
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node.setdefault(steps[-1], []).append(value)
    literal = [f"{_quoted(k)}, {_quoted(v)}" for k, v in (fields or {}).items()]
    return f"named_struct({', '.join([*literal, *_fields(tree, tree)])})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fields(node: dict, shape: dict) -> list[str]:
    """Names and values of a struct; fields of the shape that the node does not have are null."""
    return [f"{_quoted(k)}, {_compose(node[k], inner) if k in node else 'null'}" for k, inner in shape.items()]


def _is_array(node) -> bool:
    return isinstance(node, dict) and any(isinstance(k, int) for k in node)


def _filled(node) -> str:
    """Condition that any value below is there."""
    if isinstance(node, list):
        return " OR ".join(f"{leaf} IS NOT NULL" for leaf in node)
    return " OR ".join(_filled(child) for child in node.values())


def _merged(nodes: list):
    """Shape of all items of an array, so that they have one element type."""
    if any(isinstance(n, list) for n in nodes):
        return []
    return {k: _merged([n[k] for n in nodes if k in n]) for k in dict.fromkeys(k for n in nodes for k in n)}


def _compose(node, shape) -> str:
    if isinstance(node, list):
        return node[0] if len(node) == 1 else f"coalesce({', '.join(reversed(node))})"
    if not _is_array(node):
        return f"CASE WHEN {_filled(node)} THEN named_struct({', '.join(_fields(node, shape))}) END"
    element = _merged(list(node.values()))
    array = f"array({', '.join(_item(node.get(i), element) for i in range(max(node) + 1))})"
    if max(node) == 0:
        return f"CASE WHEN {_filled(node)} THEN {array} END"
    sizes = " ".join(f"WHEN {_filled(node[i])} THEN slice({array}, 1, {i + 1})" for i in sorted(node, reverse=True))
    return f"CASE {sizes} END"


def _item(node, shape) -> str:
    """Item of an array: never null as a whole where items are containers."""
    if not isinstance(shape, dict):
        return "null" if node is None else _compose(node, shape)
    if _is_array(shape):
        return "array()" if node is None else f"coalesce({_compose(node, shape)}, array())"
    return f"named_struct({', '.join(_fields(node or {}, shape))})"


def _rule(record_type: str, path: str, column: str) -> str:
    """Name of the rule of ``coerce_value`` that applies; for references to a known type, that type."""
    if record_type == "Patient" and path == "gender":
        return "gender"
    if any(mark in path for mark in DATE_MARKS):
        return "date"
    if path == "id":
        return "id"
    if path.endswith(".reference"):
        return reference_type(column, path) or "raw"
    return "raw"


# Paths that lead to the patient, the stay and the location of a record.
PATIENT_PATHS = ("subject.reference", "patient.reference")
STAY_PATHS = ("encounter.reference", "context.encounter.reference")
PLACE_PATHS = ("location[0].location.reference",)


def _leaf_values(df: DataFrame, mapping: dict, types: list[str]) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """Values that the types of a table write, each computed once, and (path, column, rule) per type.

    Types of a table share most values: an id column is normalised once, whether it becomes the id of a
    record or a reference to it. ``_row`` is the text of the whole row, where a type finds no id.
    """
    known = {f.name: f.dataType for f in df.schema.fields}
    places: dict[str, list[tuple]] = {t: [] for t in types}
    normal: dict[str, Column] = {}
    made: dict[str, Column] = {}
    for t in types:
        for column, path in mapping[t]["columns"].items():
            if not path or column not in known:
                continue
            rule = _rule(t, path, column)
            if rule == "id" or rule in REFERENCE_TYPES.values():
                name = f"_id_{column}"
                normal.setdefault(f"_normal_{column}", ids.record_id(F.col(column)))
                made.setdefault(name, ids.filled_id(F.col(column), F.col(f"_normal_{column}")))
            else:
                name = f"_{rule}_{column}"
                made.setdefault(name, coerce_value(t, path, column, known[column]))
            places[t].append((path, name, rule))
    no_id = [F.lit(True) if not (found := _sources(places[t], "id")) else _first(found).isNull() for t in types]
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in known])
    rows = df.withColumns(normal).withColumns(made)
    return rows.withColumn("_row", F.when(reduce(lambda x, y: x | y, no_id), row)).select(*made, "_row"), places


def _sources(places: list[tuple], *paths: str) -> tuple:
    """(column, rule) at the paths, in the order in which they count: later columns of a path win."""
    return tuple((name, rule) for wanted in paths for path, name, rule in reversed(places) if path == wanted)


def _first(sources: tuple) -> Column:
    """The first id that is there."""
    found = [ids.patient_of_reference(F.col(n)) if rule == "raw" else F.col(n) for n, rule in sources]
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _shared(sources: dict[str, tuple]) -> Column:
    """The value for the type of the row; no case distinction where all types read the same columns."""
    groups: dict[tuple, list[str]] = {}
    for t, found in sources.items():
        groups.setdefault(found, []).append(t)
    if len(groups) == 1:
        return _first(next(iter(groups)))
    return reduce(
        lambda out, group: out.when(F.col("type").isin(group[1]), _first(group[0])), groups.items(), F
    )


def _linked(df: DataFrame, table: str, mapping: dict, types: list[str] | None) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """Rows by record type with their ids and the values that their records hold, and the places of the values per type."""
    chosen = [t for t in model.types_of_table(table, mapping) if types is None or t in types]
    rows, places = _leaf_values(df, mapping, chosen)
    order = list(mapping)
    kinds = [F.struct(F.lit(order.index(t)).alias("ord"), F.lit(t).alias("type")) for t in chosen]
    if len(kinds) == 1:
        rows = rows.select("*", F.lit(order.index(chosen[0])).alias("ord"), F.lit(chosen[0]).alias("type"))
    else:
        rows = rows.select("*", F.inline(F.array(*kinds)))

    own = {t: _sources(p, "id") for t, p in places.items()}
    patient = {t: own[t] if t == "Patient" else _sources(p, *PATIENT_PATHS) for t, p in places.items()}
    stay = {t: own[t] if t == "Encounter" else _sources(p, *STAY_PATHS) for t, p in places.items()}
    place = {t: _sources(p, *PLACE_PATHS) if t == "Encounter" else () for t, p in places.items()}
    by_row = F.sha1(F.concat("type", F.lit("|"), "_row").cast("binary"))
    linked = rows.withColumns(
        {
            "id": F.coalesce(_shared(own), by_row),
            "patient_id": F.coalesce(_shared(patient), by_row) if chosen == ["Patient"] else _shared(patient),
            "stay_id": F.coalesce(_shared(stay), by_row) if chosen == ["Encounter"] else _shared(stay),
            "location_id": F.substring_index(_shared(place), "/", 1),
        }
    )
    return linked, places


def _by_type(texts: dict[str, Column]) -> Column:
    """The text of the row's type; no case distinction for one type."""
    if len(texts) == 1:
        return next(iter(texts.values()))
    return reduce(lambda out, t: out.when(F.col("type") == t, texts[t]), texts, F)


def rows_to_resources(
    df: DataFrame, table: str, mapping: dict = model.MAPPING, types: list[str] | None = None
) -> DataFrame:
    """One record per row and mapped type of the table, in one pass over the rows.

    Rows: patient_id, stay_id, ord (place of the type in the mapping), type, id, location_id, resource (JSON).
    A row of a table with several types is repeated by type name and each copy builds its own record only, so
    a reader that wants the ids alone never builds the JSON. The text that stands for a whole row is put
    together only for rows without an id.
    """
    linked, places = _linked(df, table, mapping, types)
    resource = _by_type({t: _record(t, p) for t, p in places.items()})
    return linked.withColumn("resource", resource).select(*RECORD_COLUMNS)


def dataset_to_values(dataset: dict[str, DataFrame], mapping: dict = model.MAPPING) -> tuple[DataFrame, Column]:
    """The records of a dataset before they are JSON: ids and a struct of values per table; and the JSON of such a row.

    What is shuffled then are the values, without names and brackets, and the JSON is made once, behind the shuffle. Values that are
    the patient's or the stay's id are not held twice: the JSON reads ``patient_id`` and ``stay_id``.
    """
    parts, texts = [], {}
    for table in [t for t in dict.fromkeys(rule["table"] for rule in mapping.values()) if t in dataset]:
        linked, places = _linked(dataset[table], table, mapping, None)
        same = _same_as_link(places)
        names = dict.fromkeys(name for p in places.values() for path, name, _ in p if path != "id" and name not in same)
        names = list(names) or ["id"]
        parts.append(linked.select(*RECORD_COLUMNS[:-1], F.struct(*names).alias(f"_{table}")))
        texts |= {t: _record(t, p, f"`_{table}`.", same) for t, p in places.items()}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), _by_type(texts)


def _same_as_link(places: dict[str, list[tuple]]) -> dict[str, str]:
    """Leaf values that are the patient_id or the stay_id of every row of a table, whatever its type."""
    same = {}
    for link, owner, paths in (("patient_id", "Patient", PATIENT_PATHS), ("stay_id", "Encounter", STAY_PATHS)):
        sources = {_sources(p, *paths) for p in places.values()}
        if owner not in places and len(sources) == 1 and len(found := next(iter(sources))) == 1 and found[0][1] == owner:
            same[found[0][0]] = link
    return same


def _record(record_type: str, places: list[tuple], within: str = "", same: dict[str, str] | None = None) -> Column:
    """The record of a type as JSON, from the leaf values (columns, fields of a struct, or the same in another column) and the id."""
    leaves = [("id", "id")]
    for path, name, rule in places:
        if path != "id":
            to_type = rule in REFERENCE_TYPES.values()
            value = f"`{same[name]}`" if same and name in same else f"{within}`{name}`"
            leaves.append((path, f"concat('{rule}/', {value})" if to_type else value))
    return F.expr(f"to_json({set_paths(leaves, resource_defaults(record_type))})")


def dataset_to_resources(dataset: dict[str, DataFrame], mapping: dict = model.MAPPING) -> DataFrame:
    """Records of all tables that the dataset holds."""
    tables = [t for t in dict.fromkeys(rule["table"] for rule in mapping.values()) if t in dataset]
    return reduce(DataFrame.unionByName, [rows_to_resources(dataset[t], t, mapping) for t in tables])


GROUPS = {"patient": "patient_id", "encounter": "stay_id"}


def grouped(resources: DataFrame, strategy: str = "patient") -> DataFrame:
    """Add bundle_id; records without a patient (or without a stay) belong to no bundle."""
    if strategy not in GROUPS:
        raise ValueError(f"unknown bundle strategy: {strategy}")
    key = F.col(GROUPS[strategy])
    return resources.filter(key.isNotNull()).withColumn("bundle_id", F.concat(F.lit(f"{strategy}-"), key))


def stub_rows(members: DataFrame) -> DataFrame:
    """A candidate stub for every location that an Encounter of a bundle refers to."""
    stub = F.struct(
        F.lit("Location").alias("resourceType"),
        F.col("location_id").alias("id"),
        F.concat(F.lit(STUB_NAME), F.col("location_id")).alias("name"),
        F.lit("active").alias("status"),
    )
    return members.filter(F.col("location_id").isNotNull()).select(
        "bundle_id",
        F.lit(STUB_ORD).alias("ord"),
        F.lit("Location").alias("type"),
        F.col("location_id").alias("id"),
        F.to_json(stub).alias("resource"),
    )


def dedupe_resources(members: DataFrame) -> DataFrame:
    """One row per (bundle, type, id): the first in mapping order. Rows without an id: see ``with_id``.

    The "first row per group" form lets Spark keep one row per group in every task before the shuffle, so
    a group made of very many copies does not travel. Stubs (negative ord) give way to real records.
    """
    last_resort = F.when(F.col("ord") < 0, 1).otherwise(0)
    # The id comes first: sorts compare the first bytes, which all bundle ids share.
    first = W.partitionBy("id", "type", "bundle_id").orderBy(last_resort, "ord", "resource")
    return members.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def with_id(members: DataFrame) -> DataFrame:
    """Drop records without an id. Records made from table rows always have one, so they need no such filter."""
    return members.filter(F.col("id").isNotNull() & (F.col("id") != ""))


def bundle_rows(resources: DataFrame, strategy: str = "patient") -> DataFrame:
    """(bundle_id, ord, type, id, resource) of all records in bundles, and candidate stubs; copies still in."""
    members = grouped(resources, strategy)
    return members.select("bundle_id", "ord", "type", "id", "resource").unionByName(stub_rows(members))


def bundle_members(resources: DataFrame, strategy: str = "patient") -> DataFrame:
    """Deduplicated records of the bundles plus the stubs they need.

    Stubs and copies are settled by the same window, so both cost one shuffle in all.
    """
    return dedupe_resources(bundle_rows(resources, strategy))


def location_stubs(resources: DataFrame, strategy: str = "patient") -> DataFrame:
    """The stubs alone: locations referred to by the Encounters of a bundle and not part of it."""
    return bundle_members(resources, strategy).filter(F.col("ord") == STUB_ORD)


def entry_url() -> Column:
    return F.concat_ws("/", "type", "id")


def transaction_entries(members: DataFrame) -> DataFrame:
    """One PUT entry (JSON) per record. The record is text already, so it is put in, not parsed again."""
    return members.select(
        "bundle_id", "ord", "type", "id", entry_url().alias("url"), _entry(F.col("resource")).alias("entry")
    )


def _entry(resource: Column) -> Column:
    request = F.to_json(F.struct(F.lit("PUT").alias("method"), entry_url().alias("url")))
    return F.concat(F.lit('{"resource":'), resource, F.lit(',"request":'), request, F.lit("}"))


def _stub_keys(members: DataFrame, with_locations: bool) -> DataFrame:
    """bundle_id, id of the stubs that the bundles need: locations referred to and not among their records."""
    wanted = members.filter("location_id IS NOT NULL").select("bundle_id", F.col("location_id").alias("id")).distinct()
    if not with_locations:
        return wanted
    return wanted.join(members.filter("type = 'Location'").select("bundle_id", "id"), ["bundle_id", "id"], "left_anti")


def _one_of_many_copies(members: DataFrame, resource: Column, many: DataFrame) -> DataFrame:
    """Bundles in which a record has very many copies: one copy per record, found in every task before the shuffle."""
    rest = members.join(many, "bundle_id", "left_anti")
    first = W.partitionBy("id", "type", "bundle_id").orderBy("ord", "_text")
    some = members.join(many, "bundle_id", "left_semi").withColumn("_text", resource)
    some = some.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_text")
    return rest.unionByName(some)


def build_bundles(
    records_: DataFrame, strategy: str = "patient", resource: Column | None = None, with_locations: bool = True
) -> DataFrame:
    """Transaction bundles as lines (bundle_id, ord, type, id, kind, value): head, one line per entry, tail.

    The lines of a bundle, in the order of (ord, id) and put together, are its document, whatever its size: head, stubs,
    records in mapping order and then by id, tail. Bundles are dealt by ranges of their id and sorted as values; a task makes
    the JSON behind its sort, and heads and tails from the first and the last record. A bundle of more than ``MANY_COPIES``
    records, such as one that holds a third of all, is dealt by ranges of (bundle_id, ord, id) instead, so it is written by many
    tasks, each of which passes its lines on one by one; the document then goes on in the next file. The head of such a bundle
    is a row with the place of its first entry, so both meet in one task and the entry knows that no comma goes before it.
    Eager up to the count of records per bundle, which sees their keys alone.

    Of copies (same bundle, type and id) the smaller JSON text counts. ``resource``: the JSON of a row, made behind the
    shuffle; the column ``resource`` by default. ``with_locations``: whether the records may hold Locations of their own.
    """
    members, seen = grouped(records_, strategy), Observation()
    # Behind the shuffle the key is read off the bundle's id; a record that is JSON already needs neither of its links.
    unused = ["location_id", *(GROUPS.values() if resource is None else [GROUPS[strategy]])]
    resource = F.col("resource") if resource is None else resource
    sizes = members.groupBy("bundle_id").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("rows"))
    large = stored(sizes.filter(F.col("n") > MANY_COPIES).select("bundle_id"), "large-bundles")
    stubs = _stub_keys(members, with_locations).select(
        "bundle_id", F.lit(STUB_ORD).alias("ord"), F.lit("Location").alias("type"), "id"
    )
    whole = large.isEmpty()
    keys = ["bundle_id"] if whole else ["bundle_id", "_cut_ord", "_cut_id"]
    if not whole:
        copies = members.select("bundle_id", "type", "id").join(large, "bundle_id", "left_semi")
        copies = copies.groupBy("bundle_id", "type", "id").agg(F.count("*").alias("n")).filter(F.col("n") > MANY_COPIES)
        many = stored(copies.select("bundle_id").distinct(), "many-copies")
        members = members if many.isEmpty() else _one_of_many_copies(members, resource, many)

    def lines(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("_kind", F.lit(kind))

    parts = [lines(members, 1).drop(*unused), lines(stubs, 1)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not whole:
        ids_ = every.select("bundle_id", "ord", "id").join(large, "bundle_id", "left_semi")
        heads = stored(ids_.groupBy("bundle_id").agg(F.min(F.struct("ord", "id")).alias("first")), "bundle-heads")
        head = heads.select("bundle_id", "first.ord", "first.id")
        tail = heads.select("bundle_id", F.lit(TAIL_ORD).alias("ord"), F.lit("").alias("id"))
        every = every.unionByName(lines(head, 0), allowMissingColumns=True).unionByName(lines(tail, 2), allowMissingColumns=True)
        every = every.join(large.withColumn("_large", F.lit(True)), "bundle_id", "left")
        every = every.withColumns({"_cut_ord": F.expr("CASE WHEN _large THEN ord END"), "_cut_id": F.expr("CASE WHEN _large THEN id END")})
    # The session's number of ranges, more where a task would sort too much.
    wanted = -(-(seen.get["rows"] or 0) // SORTED_ROWS)
    many_ranges = [wanted] if wanted > int(records_.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = every.repartitionByRange(*many_ranges, *keys).sortWithinPartitions(*keys, "ord", "id", "_kind")
    dealt = dealt.withColumn(GROUPS[strategy], F.expr(f"substring(bundle_id, {len(strategy) + 2})"))
    stub = F.to_json(F.struct(
        F.lit("Location").alias("resourceType"), "id", F.concat(F.lit(STUB_NAME), "id").alias("name"), F.lit("active").alias("status"),
    ))
    text = F.when(F.col("_kind") == 1, F.when(F.col("ord") == STUB_ORD, stub).otherwise(resource))
    # The windows follow the order of the sort, so no row is sorted with its JSON.
    place = W.partitionBy(*keys, "ord", "id")
    placed = dealt.withColumn("_text", text).withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_before", F.lag("_kind").over(place.orderBy("_kind")))
    least = F.min(F.when(F.col("_kind") == 1, F.struct("_text", "_row"))).over(place)
    kept = placed.withColumn("_least", least["_row"]).filter("_kind <> 1 OR _row = _least")
    within = W.partitionBy(*keys).orderBy("ord", "id")
    small = F.lit(True) if whole else F.col("_large").isNull()
    kept = kept.withColumn("_first", small & F.lag("_kind").over(within).isNull())
    kept = kept.withColumn("_last", small & F.lead("_kind").over(within).isNull())
    start = F.to_json(F.struct(
        F.lit("Bundle").alias("resourceType"), F.lit("transaction").alias("type"), F.col("bundle_id").alias("id"),
    ))

    def line(kind: str, value: Column, ord_: Column = F.col("ord"), type_: Column = F.col("type"), id_: Column = F.col("id")) -> Column:
        fields = {"ord": ord_, "type": type_, "id": id_, "kind": F.lit(kind), "value": value}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    no_type, none = F.lit(None).cast("string"), F.array()
    comma = F.when(F.col("_first") | (~small & F.col("_before").isNotNull()), "").otherwise(",")
    entry = F.array(line("entry", F.concat(comma, _entry(F.col("_text")))))
    head = F.array(line("head", F.concat(F.rtrim(start, F.lit("}")), F.lit(',"entry":[')), type_=no_type))
    tail = F.array(line("tail", F.lit("]}"), F.lit(TAIL_ORD), no_type, F.lit("")))
    made = F.concat(F.when(F.col("_first"), head).otherwise(none), entry, F.when(F.col("_last"), tail).otherwise(none))
    if not whole:
        made = F.when(F.col("_kind") == 0, head).when(F.col("_kind") == 2, tail).otherwise(made)
    return kept.select("bundle_id", F.inline(made))


def entry_counts(lines: DataFrame) -> DataFrame:
    """(bundle_id, n_entries) of bundle lines."""
    return lines.filter("kind = 'entry'").groupBy("bundle_id").agg(F.count("*").alias("n_entries"))


def bundle_by_patient(resources: DataFrame) -> DataFrame:
    return build_bundles(resources, "patient")


def bundle_by_encounter(resources: DataFrame) -> DataFrame:
    """One bundle per stay: the Encounter and the records that refer to it. Records without a stay are left out."""
    return build_bundles(resources, "encounter")


def export_summary(
    resources: DataFrame, strategy: str = "patient", types: Sequence[str] = ()
) -> DataFrame:
    """(item, n): records per type before copies are dropped, and the number of bundles as ``Bundle``.

    The named types are listed even if the tables hold none of them.
    """
    per_type = resources.groupBy(F.col("type").alias("item")).agg(F.count("*").alias("n"))
    if types:
        listed = resources.sparkSession.createDataFrame([(t,) for t in types], "item string")
        per_type = listed.join(per_type, "item", "full").fillna(0, ["n"])
    groups = grouped(resources, strategy).select("bundle_id").distinct()
    return per_type.unionByName(groups.agg(F.count("*").alias("n")).select(F.lit("Bundle").alias("item"), "n"))


def bundle_size_stats(bundles: DataFrame) -> DataFrame:
    """Number of bundles and their total, mean (truncated), smallest and largest size in bytes, without line ends."""
    size = F.octet_length("value").cast("bigint")
    if "bundle_id" in bundles.columns:
        bundles, size = bundles.groupBy("bundle_id").agg(F.sum(size).alias("_size")), F.col("_size")
    return bundles.agg(
        F.count("*").alias("n_bundles"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.floor(F.avg(size)), F.lit(0)).cast("bigint").alias("avg_bytes"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_bytes"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_bytes"),
    )
