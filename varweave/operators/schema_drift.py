"""Field definitions that drift between the files of a series, by the edit distance of their header trees.

A header is a tree: sections (INFO, FORMAT), under them fields by ID, under them Number, Type and Description. The script
between two trees is the cheapest set of edits under a mapping that keeps parents: adding or removing a field costs
its nodes (FIELD and three leaves), changing a leaf costs LEAF, giving a field another ID costs RENAME and needs the same
Description, and moving a field with all its leaves to the other section costs MOVE. The costs are such that a field that
keeps its ID is always mapped to itself, a rename beats a removal with an addition whatever its leaves, and a move
only takes what is left; so equal IDs are mapped first, then the IDs of one Description by a least-cost assignment,
then what moves. Scripts are compiled into projections that give every file's fields the names and types of one table.

Files are compared in one pass over range-partitioned, sorted rows, so a series of any size is spread over tasks; each
partition's first file is joined with the last one of the partition before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varweave.operators.skew import salted_join
from varweave.session import cut

#: Costs of edits. FIELD is a field's own node, beside its three leaves.
LEAF, FIELD, RENAME, MOVE = 1, 7, 14, 19
WHOLE = FIELD + 3 * LEAF

SECTIONS = ("INFO", "FORMAT")
_LINE = re.compile(r"^##(INFO|FORMAT)=<(.*)>\s*$")
_ATTRIBUTE = re.compile(r'\s*([A-Za-z0-9_.]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)')
_NOT_ALNUM = re.compile(r"[\W_]+")

Field = tuple[str, str, str]
Tree = dict[str, dict[str, Field]]


def parse_header(header: str | None) -> Tree | None:
    """Section → ID → (Number, Type in lower case, Description reduced to letters and digits); None without a header.

    The first of repeated declarations of an ID counts; a declaration without an ID is ignored.
    """
    if header is None or not header.strip():
        return None
    tree: Tree = {s: {} for s in SECTIONS}
    for line in header.split("\n"):
        m = _LINE.match(line.strip())
        if not m:
            continue
        attributes = {}
        for k, v in _ATTRIBUTE.findall(m[2]):
            v = v.strip()
            attributes.setdefault(k, v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v)
        if attributes.get("ID"):
            field = (attributes.get("Number", ""), attributes.get("Type", "").lower(), _NOT_ALNUM.sub("", attributes.get("Description", "")).lower())
            tree[m[1]].setdefault(attributes["ID"], field)
    return tree


def _attribute_cost(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    return (a[0] != b[0]) + (a[1] != b[1])


def _least_cost(gone: Counter, new: Counter) -> int:
    """What the cheapest pairing of all of the smaller side costs, the sides being counts by (Number, Type).

    The costs are a metric, so equals are paired first. The others cost one where they share an attribute, as many of
    them as a maximum flow finds, and two where they do not.
    """
    same = gone & new
    a, free = gone - same, new - same
    links = {x: [y for y in free if _attribute_cost(x, y) == 1] for x in a}
    sent: Counter = Counter()

    def push(x: tuple[str, str], most: int, seen: set) -> int:
        for y in links[x]:
            if y in seen:
                continue
            seen.add(y)
            if free[y]:
                n = min(most, free[y])
                free[y] -= n
                sent[x, y] += n
                return n
            for z in a:
                if z != x and sent[z, y]:
                    n = push(z, min(most, sent[z, y]), seen)
                    if n:
                        sent[z, y] -= n
                        sent[x, y] += n
                        return n
        return 0

    ones = 0
    for x, n in a.items():
        while n and (more := push(x, n, set())):
            n -= more
            ones += more
    return 2 * (min(gone.total(), new.total()) - same.total()) - ones


def _pair(gone: list[str], new: list[str], old: dict[str, Field], now: dict[str, Field]) -> list[tuple[str, str]]:
    """The cheapest pairing of two sets of IDs with one description, ties by name."""
    gone, new = sorted(gone), sorted(new)
    if len(gone) > len(new):
        return [(b, a) for a, b in _pair(new, gone, now, old)]
    left_gone, left_new = Counter(old[a][:2] for a in gone), Counter(now[b][:2] for b in new)
    least = _least_cost(left_gone, left_new)
    # IDs of one Number and Type are alike; of each such kind the first name comes first.
    kinds: dict[tuple[str, str], list[str]] = {}
    for b in reversed(new):
        kinds.setdefault(now[b][:2], []).append(b)
    pairs = []
    for a in gone:
        left_gone[old[a][:2]] -= 1
        for kind in sorted((k for k in kinds if kinds[k]), key=lambda k: kinds[k][-1]):
            left_new[kind] -= 1
            rest = least - _attribute_cost(old[a], kind)
            if rest >= 0 and _least_cost(left_gone, left_new) == rest:
                pairs.append((a, kinds[kind].pop()))
                least = rest
                break
            left_new[kind] += 1
    return pairs


Edit = tuple[str, str, str, str | None]


def edit_script(old: Tree, now: Tree) -> list[Edit]:
    """The cheapest script as (section, field, change, was): added, removed, renamed, retyped, described, moved.

    ``was`` is the earlier ID of a renamed or retyped field, and the earlier section of a moved one. A retyped field has another
    Number or Type, a described one another Description (letters and digits). Ties go by name.
    """
    script: list[Edit] = []
    gone: dict[str, list[str]] = {}
    new: dict[str, list[str]] = {}
    for section in SECTIONS:
        a, b = old[section], now[section]
        gone[section], new[section] = [], []
        if a == b:
            continue
        for i in a.keys() & b.keys():
            if _attribute_cost(a[i], b[i]):
                script.append((section, i, "retyped", i))
            if a[i][2] != b[i][2]:
                script.append((section, i, "described", i))
        by_description: dict[str, tuple[list[str], list[str]]] = {}
        for i in a.keys() - b.keys():
            by_description.setdefault(a[i][2], ([], []))[0].append(i)
        for i in b.keys() - a.keys():
            by_description.setdefault(b[i][2], ([], []))[1].append(i)
        for description, (x, y) in by_description.items():
            pairs = _pair(x, y, a, b) if x and y and description else []
            for was, field in pairs:
                script.append((section, field, "renamed", was))
                if _attribute_cost(a[was], b[field]):
                    script.append((section, field, "retyped", was))
            gone[section] += [i for i in x if i not in {p[0] for p in pairs}]
            new[section] += [i for i in y if i not in {p[1] for p in pairs}]
    for source, target in (SECTIONS, SECTIONS[::-1]):
        for i in sorted(set(gone[source]) & set(new[target])):
            if old[source][i] == now[target][i]:
                script.append((target, i, "moved", source))
                gone[source].remove(i)
                new[target].remove(i)
    for section in SECTIONS:
        script += [(section, i, "removed", None) for i in gone[section]]
        script += [(section, i, "added", None) for i in new[section]]
    return script


def script_cost(script: list[Edit], old: Tree, now: Tree) -> int:
    """What a script costs."""
    cost = {"added": WHOLE, "removed": WHOLE, "renamed": RENAME, "moved": MOVE, "described": LEAF}
    return sum(LEAF * _attribute_cost(old[s][str(was)], now[s][f]) if change == "retyped" else cost[change] for s, f, change, was in script)


def section_changes(script: list[Edit]) -> list[Edit]:
    """The script as each section sees it: a move is a removal in one and an addition in the other; descriptions do not count."""
    out: list[Edit] = []
    for section, field, change, was in script:
        if change == "moved":
            out += [(str(was), field, "removed", None), (section, field, "added", None)]
        elif change != "described":
            out.append((section, field, change, was))
    return out


_SORTED = ["series", "written_at", "file_id"]
_SCHEMA = "file_id long, section string, field string, change string, was string, edge string, series string, header string, pid int"
_COLUMNS = [c.strip().split(" ")[0] for c in _SCHEMA.split(",")]
_BORDER = "pid int, file_id long, section string, field string, change string, was string"


def _files(files: DataFrame, *more: str) -> DataFrame:
    chosen = files.select("file_id", "series", "written_at", "header", *more).filter(
        F.col("series").isNotNull() & F.col("file_id").isNotNull() & (F.length(F.trim("header")) > 0)
    )
    return chosen.repartitionByRange(*_SORTED).sortWithinPartitions(*_SORTED)


def _borders(edges: DataFrame) -> DataFrame:
    """The scripts across the borders of partitions where the series goes on; a border without an edit has a row of nulls.

    ``edges`` has pid, edge, file_id, series and header: the first and last file of each partition that has files. Their partitions' numbers,
    a number each, are what comes to the driver.
    """
    spark = edges.sparkSession
    filled = sorted(r[0] for r in edges.filter("edge = 'first'").select("pid").collect())
    after = spark.createDataFrame(list(zip(filled, filled[1:])), "__pid int, __next int")
    last = edges.filter("edge = 'last'").join(after, F.col("pid") == F.col("__pid")).select("__next", F.col("series").alias("__series"), F.col("header").alias("was_header"))
    met = edges.filter("edge = 'first'").join(last, (F.col("pid") == F.col("__next")) & (F.col("series") == F.col("__series")))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, file_id, header, old in zip(batch["pid"], batch["file_id"], batch["header"], batch["was_header"]):
                a, b = parse_header(old), parse_header(header)
                if a is not None and b is not None:
                    rows += [(pid, file_id, *edit) for edit in edit_script(a, b)] + [(pid, file_id, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in _BORDER.split(",")])

    return met.select("pid", "file_id", "header", "was_header").mapInPandas(across, _BORDER)


def schema_changes(files: DataFrame) -> DataFrame:
    """Every change against the file before it in the same series: file_id, section, field, change, was.

    Changes are added, removed, renamed and retyped, by section. ``files`` has file_id, series, written_at and header; more
    columns are ignored. Files are ordered by written_at, then file_id; rows with a null or empty header, a null series or
    a null file_id are passed over; a null written_at comes first. A file delivered again shows no change against
    itself. The result is a set.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_series, last_tree, last_row = None, None, None
        first = True
        for batch in batches:
            rows = []
            for file_id, series, header in zip(batch["file_id"], batch["series"], batch["header"]):
                tree = parse_header(header)
                if tree is None:
                    continue
                row = (file_id, None, None, None, None, None, series, header, pid)
                if first:
                    rows.append((*row[:5], "first", *row[6:]))
                    first = False
                elif series == last_series:
                    rows += [(file_id, *edit, None, None, None, pid) for edit in section_changes(edit_script(last_tree, tree))]
                last_series, last_tree, last_row = series, tree, row
            yield pd.DataFrame(rows, columns=_COLUMNS)
        if last_row is not None:
            yield pd.DataFrame([(*last_row[:5], "last", *last_row[6:])], columns=_COLUMNS)

    # Written once: the borders and the changes are two reads of the same pass.
    scanned = cut(_files(files).mapInPandas(scan, _SCHEMA))
    names = ["file_id", "section", "field", "change", "was"]
    within = scanned.filter(F.col("edge").isNull()).select(*names)
    over = _borders(scanned.filter(F.col("edge").isNotNull())).filter(F.col("change").isNotNull() & (F.col("change") != "described"))
    moved = F.col("change") == "moved"
    two = F.array(F.struct(F.col("was").alias("section"), F.lit("removed").alias("change")), F.struct("section", F.lit("added").alias("change")))
    apart = over.filter(moved).select("file_id", F.explode(two).alias("x"), "field").select("file_id", "x.section", "field", "x.change", F.lit(None).cast("string").alias("was"))
    return within.unionByName(over.filter(~moved).select(*names)).unionByName(apart).distinct()


_TABLE_SCHEMA = "file_id long, series string, section string, field string, declared string, number string, type string, value string, open boolean, pid int, edge string, header string"
_TABLE_COLUMNS = [c.strip().split(" ")[0] for c in _TABLE_SCHEMA.split(",")]

#: Section and ID in a file → (section, ID under which the field first appeared).
Names = dict[tuple[str, str], tuple[str, str]]


def projection(names: Names, old: Tree, now: Tree) -> Names:
    """The script between two trees compiled into a projection: every field of the later one with its first name."""
    source = {(s, f): (s, str(was)) for s, f, change, was in edit_script(old, now) if change == "renamed"}
    out: Names = {}
    for section in SECTIONS:
        for field in now[section]:
            was = source.get((section, field), (section, field))
            out[section, field] = names.get(was, was) if was[1] in old[section] else (section, field)
    return out


def consistent_table(files: DataFrame) -> DataFrame:
    """One row for each file and declared field, under the name the series first gave it and with a type all its files share.

    The edit scripts of a series are compiled into a projection for each of its files: ``field`` is the first name, ``declared``
    the file's own, ``number`` and ``type`` as declared (type in lower case), ``value`` what the file's first record gives
    an INFO field (empty for a flag, null if absent). ``common_type`` is the narrowest type that holds the field in all files of its
    series (bigint, double, boolean or string; a field of several Numbers or of lists is a string), and ``value_int``, ``value_float``
    and ``value_flag`` are the value cast to it, null for a value that is none. A moved field starts anew in its section. Order,
    repeats and null or empty headers are treated as in ``schema_changes``. Rows are range-partitioned; of each partition the
    names at its border, no more than one file's fields, are chained on the driver.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        series, tree, names, file_id = None, None, {}, None
        first_series, opening, first, last = None, set(), None, None
        for batch in batches:
            rows = []
            for fid, ser, header, info in zip(batch["file_id"], batch["series"], batch["header"], batch["first_info"]):
                now = parse_header(header)
                if now is None or (fid == file_id and ser == series):
                    continue
                if ser == series:
                    names = projection(names, tree, now)
                else:
                    names = {(s, f): (s, f) for s in SECTIONS for f in now[s]}
                if first is None:
                    first_series, opening = ser, set(names)
                    first = (fid, ser, None, None, None, None, None, None, None, pid, "first", header)
                    rows.append(first)
                series, tree, file_id = ser, now, fid
                is_open = ser == first_series
                values = dict(x.split("=", 1) if "=" in x else (x, "") for x in (info or "").split(";") if x)
                for (section, declared), (_, field) in names.items():
                    number, kind, _ = now[section][declared]
                    value = values.get(declared) if section == "INFO" else None
                    rows.append((fid, ser, section, field, declared, number, kind, value, is_open and (section, field) in opening, pid, None, None))
                last = (fid, ser, None, None, None, None, None, None, is_open, pid, "last", header)
            yield pd.DataFrame(rows, columns=_TABLE_COLUMNS)
        if last is not None:
            # The names at the end of the partition that a later one may need: those another partition gave, or that changed.
            ends = [(last[0], last[1], s, f, d, None, None, None, o, pid, "name", None) for (s, d), (_, f) in names.items() if (o := last[8] and (s, f) in opening) or d != f]
            yield pd.DataFrame([last, *ends], columns=_TABLE_COLUMNS)

    scanned = cut(_files(files, "first_info").mapInPandas(scan, _TABLE_SCHEMA))
    edges = scanned.filter(F.col("edge").isNotNull())
    goes_on: dict[int, dict[tuple[str, str], tuple[str, str]]] = {}
    for r in _borders(edges.filter("edge <> 'name'").select("pid", "edge", "file_id", "series", "header")).filter("change IS NULL OR change = 'renamed'").collect():
        renamed = goes_on.setdefault(r["pid"], {})
        if r["change"]:
            renamed[r["section"], r["field"]] = (r["section"], r["was"])
    ends: dict[int, list] = {}
    for r in edges.filter("edge <> 'last'").select("pid", "edge", "section", "field", "declared", "open").collect():
        ends.setdefault(r["pid"], []).extend([r] if r["edge"] == "name" else [])
    moved: list[tuple[int, str, str, str]] = []
    before: Names = {}
    for pid in sorted(ends):
        start: Names = {}
        if pid in goes_on:
            start = {k: v for k, v in before.items() if k not in goes_on[pid]}
            start |= {k: before.get(was, was) for k, was in goes_on[pid].items()}
            start = {k: v for k, v in start.items() if k != v}
        moved += [(pid, s, f, name[1]) for (s, f), name in start.items()]
        before = {}
        for r in ends[pid]:
            key = (r["section"], r["field"])
            before[r["section"], r["declared"]] = start.get(key, key) if r["open"] else key
    rows = scanned.filter(F.col("edge").isNull())
    if moved:
        known = files.sparkSession.createDataFrame(moved, "pid int, section string, field string, __first string")
        rows = rows.join(known.withColumn("open", F.lit(True)), ["pid", "section", "field", "open"], "left").withColumn("field", F.coalesce("__first", "field"))
    return _typed(rows.select("file_id", "series", "section", "field", "declared", "number", "type", "value").distinct())


def _typed(table: DataFrame) -> DataFrame:
    """The table with the type that a field's files share, and its value cast to it."""
    kind = (
        F.when((F.col("type") == "flag") & (F.col("number") == "0"), "boolean")
        .when((F.col("type") == "integer") & (F.col("number") == "1"), "bigint")
        .when((F.col("type") == "float") & (F.col("number") == "1"), "double")
        .otherwise("string")
    )
    keys = ["series", "section", "field"]
    kinds = table.groupBy(*keys).agg(F.array_sort(F.collect_set(kind)).alias("k"))
    numbers = (F.size("k") == 2) & (F.col("k") == F.array(F.lit("bigint"), F.lit("double")))
    common = kinds.select(*[F.col(k).alias(f"__{k}") for k in keys], F.when(F.size("k") == 1, F.col("k")[0]).when(numbers, "double").otherwise("string").alias("common_type"))
    met = salted_join(table, common, [(k, f"__{k}") for k in keys], F.col("file_id"))
    is_a = lambda t, c: F.when(F.col("common_type") == t, c)
    return met.select(
        *table.columns,
        "common_type",
        is_a("bigint", F.col("value").try_cast("bigint")).alias("value_int"),
        is_a("double", F.col("value").try_cast("double")).alias("value_float"),
        is_a("boolean", F.col("value").isNotNull()).alias("value_flag"),
    )


def wide_table(table: DataFrame, least_share: float = 0.5) -> DataFrame:
    """One row for each file, with one column of its own type for every INFO field that at least ``least_share`` of the files have.

    ``table`` is a ``consistent_table``. Columns are info_ID in the order of the IDs, typed as all series allow (bigint and
    double give double, other mixtures string). There are at most 1/least_share times as many columns as a file has fields; rarer fields,
    which most series name as they like, stay rows of the long table.
    """
    info = table.filter("section = 'INFO'")
    n = table.select("file_id").distinct().count()
    often = info.groupBy("field").agg(F.countDistinct("file_id").alias("n"), F.array_sort(F.collect_set("common_type")).alias("k")).filter(F.col("n") >= least_share * n)
    columns = []
    for r in often.orderBy("field").collect():
        kind = r["k"][0] if len(r["k"]) == 1 else "double" if r["k"] == ["bigint", "double"] else "string"
        mine = F.when(F.col("field") == r["field"], True if kind == "boolean" else F.col("value"))
        columns.append((F.coalesce(F.max(mine), F.lit(False)) if kind == "boolean" else F.max(mine).try_cast(kind)).alias(f"info_{r['field']}"))
    seen = F.max("series").alias("series")
    return table.filter(F.col("section") == "INFO").groupBy("file_id").agg(seen, *columns) if columns else table.groupBy("file_id").agg(seen)
