"""Whether what was taken from printed tables is all that they print, and nothing else.

Printed cells are consumed by claimed values, each used once. The order in which cells take them, best-fitting column first, is a
rank within each pool of equal values, so the greedy consumption of many tables at once is one sort by pool, not a loop over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.helm import let
from ..functions.text import printed

#: Digits that name a compound, a whole cell that looks like one, doses as headers print them, and nM in their units.
NUMBER, BARE = r"\d{4,7}", r"^\s*\d{5,7}\s*$"
DOSE = r"([\d,]*\.?\d+)\s*([nNuUµμm]M)\b"
UNITS = {"nm": 1.0, "um": 1e3, "µm": 1e3, "μm": 1e3, "mm": 1e6}
#: A column with this share of its cells accounted for holds measurements, whatever its header; one left of the ids with this share of compound-like numbers is suspect.
MEASURED, SUSPECT = 0.5, 0.8
#: Claims and cells that are looked at together; a table is never cut. Both are rows of one kind.
EVENTS_AT_ONCE = 200_000
#: A cell of digits only, whose number as a text is that of a double without an exponent.
WHOLE = r"^\d{1,7}\z"


def _key(values: Column) -> Column:
    """Printed numbers as one text."""
    return F.array_join(F.transform(values, lambda x: (x + 0.0).cast("string")), ",")


def doses(text: Column) -> Column:
    """array<double>: the doses in a text, in nM."""
    number, unit = (F.regexp_extract_all(text, F.lit(DOSE), F.lit(k)) for k in (1, 2))
    factor = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u[0] + "M", n)], *[F.lit(x) for u in "nu" for x in (u.upper() + "M", UNITS[u + "m"])])
    return F.zip_with(number, unit, lambda n, u: F.round(F.translate(n, ",", "").try_cast("double") * F.element_at(factor, u), 4))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of tables from their claims and cells, some whole tables at a time; a table begins with cell 0 of line 0."""
    held, n = [], 0
    for batch in batches:
        starts = np.flatnonzero((batch["line"].to_numpy() == 0) & (batch["k"].to_numpy() == 0))
        if n + batch.num_rows >= EVENTS_AT_ONCE and len(starts):
            cut = int(starts[-1])
            if n + cut:
                yield from figures(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield from figures(pa.Table.from_batches(held)).to_batches()


def _codes(*columns: np.ndarray | pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of all columns as equal numbers from 0; -1 where there is none."""
    parts = [c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([pa.array(c)]) for c in columns]
    whole = pa.chunked_array([x for c in parts for x in c.chunks], parts[0].type).combine_chunks()
    found = pc.fill_null(pc.dictionary_encode(whole).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(c) for c in parts])[:-1])


def _group(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 for each combination."""
    out = columns[0]
    for c in columns[1:]:
        low = int(c.min()) if len(c) else 0
        # Numbers of the combination so far are fewer than rows, so that no product overflows.
        out, c = _codes(out)[0], c if c.max(initial=low) - low < 1 << 31 else _codes(c)[0]
        low = int(c.min()) if len(c) else 0
        out = out * (int(c.max(initial=low)) - low + 1) + (c - low)
    return _codes(out)[0]


def _size(group: np.ndarray) -> int:
    return int(group.max(initial=-1)) + 1


def _least(group: np.ndarray, n: int, value: np.ndarray, none) -> np.ndarray:
    """The least value of each of n groups; none where it has no rows."""
    out = np.full(n, none, value.dtype)
    order = np.lexsort((value, group))
    first = order[np.r_[True, np.diff(group[order]) != 0][: len(order)]]
    out[group[first]] = value[first]
    return out


def _mode(group: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    """The most frequent value of each of n groups, the least of equally frequent ones; -1 where it has no rows."""
    pair = _group(group, value)
    times = np.bincount(pair, minlength=_size(pair))[pair]
    order = np.lexsort((value, -times, group))
    first = order[np.r_[True, np.diff(group[order]) != 0][: len(order)]]
    out = np.full(n, -1, np.int64)
    out[group[first]] = value[first]
    return out


def figures(own: pa.Table) -> pa.Table:
    """A row a table of whole tables' claims and cells."""
    plain = lambda c: own[c].to_numpy()
    whole = lambda c: pc.fill_null(own[c], 0).to_numpy().astype(np.int64)
    start = (plain("line") == 0) & (plain("k") == 0)
    begins = np.flatnonzero(start)
    t, tables = np.cumsum(start) - 1, len(begins)
    claimed = plain("claim").astype(bool)
    # Claims and cells apart from here on: of each, its table, and the codes of its texts.
    text = _codes(own["digits"], own["name"])
    key, bare = _codes(own["key"])[0], _codes(own["bare"])[0]
    dose = _codes(pc.add(own["dose"], 0.0))[0]
    position, k, width = whole("position"), whole("k"), whole("width")
    empty = pc.fill_null(pc.equal(own["digits"], ""), False).to_numpy().astype(bool)
    unnamed = pc.fill_null(pc.equal(own["name"], ""), False).to_numpy().astype(bool)
    c, x = np.flatnonzero(claimed), np.flatnonzero(~claimed)
    ct, cname, ckey, cdose = t[c], text[0][c], key[c], dose[c]
    t, position, k, width, key, bare, head = t[x], position[x], k[x], width[x], key[x], bare[x], dose[x]
    digits, name = np.where(empty[x], -1, text[0][x]), np.where(unnamed[x], -1, text[1][x])
    span = max(int(max(a.max(initial=0) for a in text)), 0) + 2

    # The first cell of a row that names a claimed compound, by its digits before its whole text.
    said = pa.array(ct * span + cname)
    named = lambda v: (v >= 0) & pc.is_in(pa.array(t * span + v), said).to_numpy(zero_copy_only=False)
    way0 = named(digits)
    hit = np.flatnonzero(way0 | named(name))
    way, by = np.where(way0[hit], 0, 1), np.where(way0[hit], digits[hit], name[hit])
    row = _group(t, position)
    rows = _size(row)
    rank = np.zeros(len(hit), np.int64)
    if len(np.unique(pair := _group(row[hit], way, k[hit]))) < len(pair):
        rank = _ranks(own, text, by)
    order = np.lexsort((rank, k[hit], way, row[hit]))
    first = order[np.r_[True, np.diff(row[hit][order]) != 0][: len(order)]]
    id_k, compound = np.full(rows, -1, np.int64), np.full(rows, -1, np.int64)
    id_k[row[hit[first]]], compound[row[hit[first]]] = k[hit[first]], by[first]
    id_k, compound = id_k[row], compound[row]
    is_id, loose = k == id_k, id_k < 0
    ids = np.flatnonzero(is_id)
    id_column, usual = _mode(t[ids], tables, k[ids]), -_mode(t[ids], tables, -width[ids])
    n_rows = np.bincount(t[ids], minlength=tables)
    ragged = (_least(t[ids], tables, width[ids], 0) != -_least(t[ids], tables, -width[ids], 0)) & (n_rows > 0)

    # Columns: candidates are aligned, heads tell doses.
    cand = (key >= 0) & ~loose & ~is_id
    column = np.where(cand & (k > id_k), k + usual[t] - width, k)
    of = _group(t, column)
    columns = _size(of)
    heads = np.flatnonzero((key < 0) & (head >= 0) & (id_column[t] >= 0) & (k != id_column[t]))
    order = heads[np.lexsort((position[heads], of[heads]))]
    first = order[np.r_[True, np.diff(of[order]) != 0][: len(order)]]
    headed = np.full(columns, -1, np.int64)
    headed[of[first]] = head[first]

    # How many claimed values fit a candidate: those of its column's dose where its compound has any, else all of the compound's.
    p = np.flatnonzero(cand)
    pt, pkey, pof, pname, pdose = t[p], key[p], of[p], compound[p], headed[of[p]]
    pool = ckey >= 0
    dosed = pool & (cdose >= 0)

    def matches(keep: np.ndarray, of_claims: tuple, of_cells: tuple) -> np.ndarray:
        """How many of the claims to keep each candidate equals."""
        both = _group(*[np.r_[a[keep], b] for a, b in zip(of_claims, of_cells, strict=True)])
        m = int(keep.sum())
        return np.bincount(both[:m], minlength=_size(both))[both[m:]]

    all_of = matches(pool, (ct, cname, ckey), (pt, pname, pkey))
    by_dose = (matches(dosed, (ct, cname, cdose), (pt, pname, pdose)) > 0) & (pdose >= 0)
    of_dose = matches(dosed, (ct, cname, cdose, ckey), (pt, pname, pdose, pkey))
    most = np.where(by_dose, of_dose, all_of)
    n = np.bincount(pof, minlength=columns)
    fit = np.bincount(pof, most > 0, columns) / np.maximum(n, 1)
    used = np.zeros(len(p), bool)
    some = np.flatnonzero(most > 0)
    taken = _group(pt[some], pname[some], np.where(by_dose[some], column[p][some], -1), pkey[some])
    order = np.lexsort((position[p][some], column[p][some], -fit[pof[some]], taken))
    starts = np.r_[True, np.diff(taken[order]) != 0][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    used[some[order]] = place < most[some[order]]

    # Of columns: which hold measurements, which are partial or look like ids.
    m = np.bincount(pof, used, columns)
    measured = (n > 0) & ((headed >= 0) | (m >= MEASURED * n))
    b = np.flatnonzero(bare[p] >= 0)
    bares = np.bincount(pof[b], minlength=columns)
    pair, one = np.unique(_group(pof[b], bare[p][b]), return_index=True)
    different = np.bincount(pof[b][one], minlength=columns)
    looks = (column[p] < id_column[pt]) & (bares[pof] >= SUSPECT * n_rows[pt]) & (different[pof] >= SUSPECT * n_rows[pt])
    part = np.flatnonzero((measured & (m < n))[pof])
    top = part[position[p][part] == _least(pof[part], columns, position[p][part], 0)[pof[part]]]
    top = top[k[p][top] == _least(pof[top], columns, k[p][top], 0)[pof[top]]]
    none = np.iinfo(np.int64).max
    suspect = _least(pt[looks], tables, column[p][looks], none)

    # Of tables: compounds seen, rows that nobody claims, claims that a cell prints.
    who = _group(t[ids], compound[ids])
    new = position[ids] == _least(who, _size(who), position[ids], 0)[who]
    odd, full = np.zeros(rows, bool), np.zeros(rows, bool)
    odd[row[loose & (k == id_column[t]) & (bare >= 0)]] = True
    full[row[loose & (key >= 0) & measured[of]]] = True
    table_of = np.zeros(rows, np.int64)
    table_of[row] = t
    keys = int(max(key.max(initial=0), ckey.max(initial=0))) + 2
    printed_too = pool & pc.is_in(pa.array(ct * keys + ckey), pa.array((t * keys + key)[key >= 0])).to_numpy(zero_copy_only=False)
    which, one = np.unique(_group(ct, whole("line")[c])[printed_too], return_index=True)
    count = lambda at: np.bincount(at, minlength=tables).astype(np.int64)
    same = own.select(["table_id", "n_compounds", "n_values", "n_unprinted"]).take(pa.array(begins))
    out = [*[same[n] if n == "table_id" else same[n].cast(pa.int64()) for n in same.column_names], n_rows, count(t[ids[new]]), count(pt[measured[pof]]), count(pt[used & measured[pof]]), count(pt[top]), count(table_of[odd & full]), count(ct[printed_too][one])]
    names = [*same.column_names, "n_rows", "n_seen", "n_cells", "n_accounted", "n_partial", "n_dropped", "n_sourced", "suspect_column", "ragged"]
    return pa.table([*out, pa.array(np.where(suspect == none, 0, suspect), mask=suspect == none).cast(pa.int32()), pa.array(ragged)], names)


def _ranks(own: pa.Table, text: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Places of texts in their order, by their codes."""
    texts = {code: value for column, of in zip(("digits", "name"), text, strict=True) for code, value in zip(of.tolist(), own[column].to_pylist(), strict=True) if code >= 0}
    place = {code: i for i, code in enumerate(sorted(texts, key=lambda code: texts[code].encode()))}
    return np.array([place[code] for code in codes.tolist()], np.int64)


def report(rows: DataFrame, claims: DataFrame, mirror: bool = True) -> DataFrame:
    """A row a table of rows (table_id, position, cells) and claims (table_id, compound, dose in nM or null, value as text).

    n_rows that name a claimed compound, n_compounds claimed and n_missing of them from the table, n_cells of measurement columns and
    n_accounted of them, coverage_pct; n_dropped: rows that name a compound nobody claims, in the column of ids and with a number in a
    measurement column; n_unsourced: claimed values that no cell prints; n_unprinted: claimed doses, of two or more, that no cell
    prints, where any does; suspect_column: a column left of the ids that looks like ids; n_partial columns; ragged.

    With mirror a value of 100 less is as good (control and inhibition). Rows shorter than most are aligned at their right end. A
    column headed with a dose is of measurements and is held against claims of that dose; others are by MEASURED. A table without
    claims has no row here; one in which no row names a compound has no cells. A table's rows and claims meet in one task, once:
    rows and claims dealt by table_id alone move no more.
    """
    name = F.coalesce(F.nullif(F.regexp_extract(F.col("compound").cast("string"), NUMBER, 0), F.lit("")), F.lower(F.trim(F.col("compound").cast("string"))))
    # A claim's line holds its value in its forms, a row's its cells.
    text, value = F.col("text"), F.col("value").cast("string")
    one = lambda v: F.array(F.round(100 - F.get(v, F.lit(0)), 6))
    forms = lambda v: F.when(F.lit(mirror) & (F.size(v) == 1), F.array(_key(v), _key(one(v)))).otherwise(F.array(_key(v)))
    number = value.cast("double")
    whole_forms = F.array(number.cast("string"), *([(F.round(100 - number, 6) + 0.0).cast("string")] if mirror else []))
    line = lambda claim, position, cells, compound, dose: F.struct(F.lit(claim).alias("claim"), position.cast("long").alias("position"), cells.alias("cells"), compound.cast("string").alias("compound"), dose.cast("double").alias("dose"))
    said = claims.select("table_id", name.alias("compound"), "dose", F.when(value.rlike(WHOLE), whole_forms).otherwise(forms(printed(value))).alias("forms")).where("compound <> ''")
    said = said.groupBy("table_id").agg(F.collect_list(line(True, F.lit(None), F.col("forms"), F.col("compound"), F.col("dose"))).alias("said"))
    none = F.lit(None)
    whole = said.join(rows.groupBy("table_id").agg(F.collect_list(line(False, F.col("position"), F.col("cells"), none, none)).alias("rows")), "table_id", "left")

    # Of the table as a whole: how much is claimed, and which claimed doses no cell prints.
    asked = F.array_distinct(F.filter(F.col("said.dose"), lambda d: d.isNotNull()))
    shown = F.array_distinct(F.filter(doses(F.array_join(F.filter(F.flatten("rows.cells"), lambda c: c.contains("M")), "|")), lambda d: d.isNotNull()))
    unprinted = lambda x: F.when((F.size(x["asked"]) > 1) & (F.size(x["shown"]) > 0), F.size(F.filter(x["asked"], lambda a: ~F.exists(x["shown"], lambda s: F.abs(a - s) <= F.greatest(F.lit(0.01), 1e-3 * s))))).otherwise(0)
    n_values = F.size(F.filter("said", lambda x: F.get(x["cells"], F.lit(0)).isNotNull()))
    whole = whole.select("*", F.size(F.array_distinct("said.compound")).alias("n_compounds"), n_values.alias("n_values"), let(F.struct(asked.alias("asked"), shown.alias("shown")), unprinted).alias("n_unprinted"))

    # Claimed values and cells become rows of one kind, a table's one after another, so that what follows looks them up there.
    own = ["table_id", "n_compounds", "n_values", "n_unprinted"]
    at = whole.select(*own, F.posexplode(F.concat("said", F.coalesce("rows", F.filter("said", lambda x: F.lit(False))))).alias("line", "x"))
    at = at.select(*own, "line", "x.claim", "x.position", "x.compound", "x.dose", F.size("x.cells").alias("width"), F.posexplode("x.cells").alias("k", "text"))
    at = at.withColumn("plain", F.coalesce(~F.col("claim") & text.rlike(WHOLE), F.lit(False))).withColumn("key", F.when(F.col("claim"), text).when(F.col("plain"), text.cast("double").cast("string")).otherwise(_key(printed(text))))
    plain, size = F.col("plain"), F.length(text)
    at = at.withColumns({
        "digits": F.when(F.col("claim"), F.col("compound")).when(plain, F.when(size >= 4, text).otherwise("")).otherwise(F.regexp_extract(text, NUMBER, 0)),
        "name": F.when(F.col("claim") | (plain & (size >= 4)), None).when(plain, text).otherwise(F.lower(F.trim(text))),
        "bare": F.when(F.col("claim"), None).when(plain, F.when(size >= 5, text)).when(text.rlike(BARE), text),
        "dose": F.when(F.col("claim"), F.col("dose")).when(plain | F.col("key").isNotNull() | ~text.contains("M"), None).otherwise(F.get(doses(text), F.lit(0))),
    })
    at = at.select("table_id", "n_compounds", "n_values", "n_unprinted", "line", "claim", "position", "k", "width", "digits", "name", "key", "bare", "dose")
    kind = at.schema["table_id"].dataType.simpleString()
    out = at.mapInArrow(_counted, f"table_id {kind}, n_compounds long, n_values long, n_unprinted long, n_rows long, n_seen long, n_cells long, n_accounted long, n_partial long, n_dropped long, n_sourced long, suspect_column int, ragged boolean")
    whole_number = lambda c: c.cast("long")
    return out.select(
        "table_id", whole_number(F.col("n_rows")).alias("n_rows"), whole_number(F.col("n_compounds")).alias("n_compounds"), whole_number(F.col("n_compounds") - F.col("n_seen")).alias("n_missing"), "n_cells", "n_accounted", F.round(F.try_divide(100 * F.col("n_accounted"), F.col("n_cells")), 2).alias("coverage_pct"),
        "n_dropped", whole_number(F.col("n_values") - F.col("n_sourced")).alias("n_unsourced"), whole_number(F.col("n_unprinted")).alias("n_unprinted"), "n_partial", "suspect_column", F.coalesce("ragged", F.lit(False)).alias("ragged"),
    )
