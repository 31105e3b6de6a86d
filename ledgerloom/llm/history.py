"""Problem 4: each new batch of documents against all accepted before, by a table of pivot distances.

A text is read once into the identity of its business document: vendor without legal form, number
with letters and digits that are easily confused folded together, date, total, goods, order number
and recipient, in whatever language, layout or order. Documents are points of a metric space:

    64 |days| + 16 |digits of the numbers| + 16 edits of their letters + 4 edits of the vendors
    + 4 |cents| + |cents of all goods| and 64 if the goods differ + 16 (order numbers) + 4 edits of the recipients

over the fields that a space names (a sum of metrics is one). The history is a table of distances:
it has every point's distances to fixed pivots, documents of the first batch that were chosen
farthest from each other. By the triangle inequality two points within ``RADIUS`` differ by no more
in any of them. The distances are cut into cells and the cells into ranges, which are the folders of
the table; a batch reads the ranges that its own distances reach, joins their cells, and the true
distance decides. Only the batch's texts are read and only its points are measured and appended.

Points, not rows, are joined, and a document sent a million times is one point: rows are folded by
an aggregate that combines before the shuffle. Points at the same place of a space are folded again,
so near points are linked to one of each place, not to each other.

Documents that lost their number are compared in spaces without it, the finest first (``LEVELS``).
There the places of numbered documents keep their least and greatest document, so a place that
holds a third of all rows is one row.

Defined results
  * null, empty or unlabelled text, or one without vendor and date: a document of its own, no case.
  * without a number: the one numbered document near it in the finest level where any is; none where
    several are. If no numbered document is near in any level, those that lost their number are one where all their fields but the recipient or order number that both lack are equal.
  * ties go to the smallest ``doc_key``; null batches count as batch 0; other columns are ignored.
  * totals of over 2**50 cents count as that; a number's digits beyond the fifteenth are compared as letters.
"""

from __future__ import annotations

import datetime
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ledgerloom.llm.graph import components
from ledgerloom.session import discard, materialise, shared_dir

# Labels of the fields in English, German and French.
LABELS = {
    "num": ["invoice number", "invoice no", "inv no", "ref", "document ref", "order number", "payment reference", "rechnungsnummer", "rechnung nr",
            "auftragsnummer", "zahlungsreferenz", "numéro de facture", "facture no", "numéro de commande", "référence de paiement"],
    "po": ["po number", "bestellnummer", "bon de commande"],
    "date": ["invoice date", "order date", "payment date", "rechnungsdatum", "auftragsdatum", "zahlungsdatum", "date de facture", "date de commande", "date de paiement"],
    "due": ["due date", "fällig am", "échéance"],
    "to": ["bill to", "empfänger", "destinataire"],
    "tax_id": ["tax id", "ust-idnr", "numéro tva"],
    "sub": ["subtotal", "zwischensumme", "sous-total"],
    "total": ["total due", "balance payable", "amount due", "amount paid", "total", "zu zahlen", "gesamtbetrag", "gezahlt", "total à payer", "net à payer", "montant payé"],
    "tax": ["tax", "vat", "mwst", "tva"],
    "note": ["note", "hinweis", "remarque"],
    "stamp": ["captured", "scanned on", "received at", "time stamp", "erfasst am", "eingegangen", "zeitstempel", "horodatage", "reçu le", "saisi le"],
}
# Lines that name the kind of document or were put on later.
KINDS = {"invoice", "tax invoice", "commercial invoice", "invoice rechnung", "rechnung", "facture", "purchase order", "payment advice", "statement", "document",
         "copy", "duplicate for your files", "resent on request", "second submission", "statement of account attached"}
# Legal forms of firms.
LEGAL = {"ag", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "limited", "llc", "ltd", "nv", "plc", "pty", "sa", "sarl", "srl"}
# Letters that are misread as digits.
CONFUSED = str.maketrans("oislzb", "015128")
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_KIND_OF = {re.sub(r"\W+", " ", label): kind for kind, labels in LABELS.items() for label in labels}
_LABEL = re.compile(r"\W*(" + "|".join(re.sub(r"\W+", r"\\W+", x) for x in sorted((x for v in LABELS.values() for x in v), key=lambda s: (-len(s), s)))
                    + r")\b(?:\W*:|\W+|$)(.*)", re.S)
_ITEM = re.compile(r"(.*?)\s+(\d+)\s+([\d.,]+)\s+([\d.,]+)\W*$")
_PIECES = re.compile(r"[\n\r|;•]+")
_MASK = (1 << 44) - 1
_FIGURE, _BESIDE, _MARKS, _DIGIT, _REST = (re.compile(x) for x in (r"\d[\d.,]*", r"[^\w. ]", r"[^a-z0-9]", r"\d", r"\D"))
_NOT_IN_NAMES = re.compile(r"[^\w ]")


def day_of(value: str) -> int | None:
    """Days of an ISO or written date (day and month order as words tell), from year 1."""
    if m := re.search(r"(\d{4})-(\d\d)-(\d\d)", value):
        y, mo, d = map(int, m.groups())
    elif m := re.search(r"(\d{1,2})[ .-]+([a-z]{3})[a-z]*[ .-]+(\d{4})", value):
        d, mo, y = int(m[1]), _MONTHS.get(m[2]), int(m[3])
    elif m := re.search(r"([a-z]{3})[a-z]*[ .-]+(\d{1,2})[, ]+(\d{4})", value):
        d, mo, y = int(m[2]), _MONTHS.get(m[1]), int(m[3])
    else:
        return None
    try:
        return datetime.date(y, mo, d).toordinal()
    except (TypeError, ValueError):
        return None


def cents_of(value: str) -> int | None:
    """Cents of an amount with either mark for decimals."""
    m = _FIGURE.search(value)
    if not m:
        return None
    figure = m[0].rstrip(".,")
    whole, part = (figure[:-3], figure[-2:]) if figure[-3:-2] in (".", ",") else (figure, "00")
    return min(int(whole.replace(".", "").replace(",", "") or 0) * 100 + int(part), _MASK)


def _name(value: str) -> str:
    words = _NOT_IN_NAMES.sub("", value.replace(".", "")).split()
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    return " ".join(words)


#: What is read of a text.
READ = {"vendor": "string", "letters": "string", "digits": "long", "day": "long", "total": "long", "goods": "long", "worth": "long", "po_letters": "string",
        "po_digits": "long", "payee": "string"}
#: The parts of each field with the weight of their difference: numbers by amount, strings by edits, ``goods`` by being equal or not.
FIELDS = {"number": {"digits": 16, "letters": 16}, "day": {"day": 64}, "vendor": {"vendor": 4}, "total": {"total": 4}, "goods": {"worth": 1, "goods": 64},
          "po": {"po_digits": 16, "po_letters": 16}, "payee": {"payee": 4}}
#: Spaces of numbered documents, and the parts that they compare.
NUMBERED = ["vendor", "letters", "digits", "day", "total"]
SPACES = {"a": ["number", "day", "vendor"], "b": ["number", "day", "total"], "n": ["number"]}
#: Spaces that are stored: those, and the one in which documents that lost their number look for others.
STORED_SPACES = {**SPACES, "v": ["vendor", "day"]}
#: Spaces without the number, finest first; the first three also join documents that all lost it.
LEVELS = [["vendor", "day", "total", "goods", "po", "payee"], ["vendor", "day", "total", "goods", "po"], ["vendor", "day", "total", "goods"],
          ["vendor", "day", "goods"], ["vendor", "day", "total", "po"], ["vendor", "day", "total"], ["vendor", "day", "po"]]
TWINS = 3
#: Near is two edits in the vendor, or two cents; cells are far wider, so a point is asked in hardly more than one.
RADIUS, CELL_BITS, PIVOTS, RANGES = 8, 10, 2, 16
#: Documents of the first batch among which the pivots are chosen, and points on which the ranges are laid out.
PIVOT_SAMPLE, RANGE_SAMPLE = 64, 20_000
_MOST = 1 << 50
_WEIGHTS = {p: w for f in FIELDS.values() for p, w in f.items()}


def _parts(value: str) -> tuple[str | None, int | None]:
    """Letters (digits as marks of their place) and digits of a number, misread ones folded together."""
    folded = _MARKS.sub("", value).translate(CONFUSED)
    if not folded:
        return None, None
    digits = _REST.sub("", folded)
    return _DIGIT.sub("#", folded) + digits[15:], int(digits[:15] or 0)


@lru_cache(10_000)
def _kind_of(label: str) -> str:
    return _KIND_OF[re.sub(r"\W+", " ", label)]


def identity(text: str | None) -> list:
    """The parts of a text in the order of ``READ``; null where the line is missing."""
    fields: dict[str, str] = {}
    goods, heads = [], []
    for piece in _PIECES.split(text.lower() if text else ""):
        line = " ".join(piece.split())
        if found := _LABEL.match(line):
            fields.setdefault(_kind_of(found[1]), found[2])
        elif found := _ITEM.match(line):
            goods.append((int(found[2]), cents_of(found[4])))
        else:
            bare = " ".join(_BESIDE.sub(" ", line).split())
            if (own := bare.strip(". ")) and own not in KINDS and not bare.startswith("reminder"):
                heads.append(bare)
    total = cents_of(fields.get("total", ""))
    worth = min(sum(c or 0 for _, c in goods), _MOST) if goods else None
    return [_name(heads[0]) if heads else None, *_parts(fields.get("num", "")), day_of(fields.get("date", "")), None if total is None else min(total, _MOST),
            xxhash.xxh64_intdigest(repr(sorted(goods, key=repr))) - (1 << 63) if goods else None, worth, *_parts(fields.get("po", "")), _name(fields.get("to", "")) or None]


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string() if k == "string" else pa.int64() for k in READ.values()]
    for batch in batches:
        columns = list(zip(*(identity(t) for t in batch.column(2).to_pylist()))) or [[]] * len(READ)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_key", "batch_no", *READ])


def read_identities(docs: DataFrame) -> DataFrame:
    """``doc_key, batch_no, point`` and the parts of every document; no shuffle."""
    own = docs.select(F.col("doc_key").cast("long"), F.coalesce(F.col("batch_no").cast("int"), F.lit(0)).alias("batch_no"), "text")
    read = own.mapInArrow(_identities, "doc_key long, batch_no int, " + ", ".join(f"{c} {k}" for c, k in READ.items()))
    known = F.col("vendor").isNotNull() & F.col("day").isNotNull() | F.col("letters").isNotNull()
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in READ]
    return read.withColumn("point", F.xxhash64(*parts, F.when(known, F.lit(0)).otherwise(F.col("doc_key"))))


def fold(rows: DataFrame) -> DataFrame:
    """One row for each point: ``id``, its smallest key, and its smallest batch."""
    return rows.groupBy("point", *READ).agg(F.min("doc_key").alias("id"), F.min("batch_no").alias("batch"))


# ---- distances -------------------------------------------------------------------------------------
# Expressions are written as SQL: a space has some thirty, and text is far quicker to hand to the JVM than calls.
def _part_distance(part: str, a: str, b: str, most: int | None = None) -> str:
    weight = _WEIGHTS[part]
    if part == "goods":
        return f"if({a} = {b}, 0, {weight})"
    if READ[part] == "long":
        return f"{weight} * abs({a} - {b})"
    if most is None:
        return f"{weight} * levenshtein({a}, {b})"
    edits = f"levenshtein({a}, {b}, {most // weight})"
    return f"if({a} = {b}, 0, if({edits} < 0, {most + 1}, {weight} * {edits}))"


def _has(fields: list[str]) -> str:
    return " and ".join(f"{next(iter(FIELDS[f]))} is not null" for f in fields)


def _literal(part: str, value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if READ[part] == "string" else f"{value}L"


def choose_pivots(points: DataFrame, many: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[dict]:
    """Pivots from a bounded sample of short documents, each the farthest from those before."""
    short = " and ".join(f"coalesce(length({c}), 0) <= 64" for c, k in READ.items() if k == "string")
    rows = points.filter(_has(["number", "day", "vendor"])).filter(short).orderBy(F.xxhash64("id")).limit(sample).collect()
    rows = rows or [Row(**{c: None for c in READ})]
    own = [{c: r[c] if r[c] is not None else ("" if k == "string" else 0) for c, k in READ.items()} for r in rows]
    far = lambda x, y: sum(abs(x[c] - y[c]) if k == "long" else abs(len(x[c]) - len(y[c])) + sum(p != q for p, q in zip(x[c], y[c])) for c, k in READ.items() if c != "goods")
    chosen = [own[0]]
    while len(chosen) < many:
        chosen.append(max(own, key=lambda x: min(far(x, p) for p in chosen)))
    return chosen


def measured(points: DataFrame, spaces: dict[str, list[str]], pivots: list[dict]) -> DataFrame:
    """A row for each point and space that it has all fields of: ``space``, the parts used, ``d1`` and so on.

    Parts that a space doesn't use are empty, so all spaces have one distance formula.
    """
    used = [p for p in READ if any(p in FIELDS[f] for fields in spaces.values() for f in fields)]
    ks = range(len(pivots))
    own = points.selectExpr("*", *[f"cast(coalesce({_part_distance(p, p, _literal(p, pivots[k][p]))}, 0) as long) as _{p}{k}" for p in used for k in ks])
    neutral = {p: "''" if kind == "string" else "0L" for p, kind in READ.items()}
    rows = []
    for space, fields in spaces.items():
        mine, exists = [p for f in fields for p in FIELDS[f]], _has(fields)
        values = {p: p if p in mine else neutral[p] for p in READ}
        if space == "n":  # numbered documents that neither other space takes
            values = {p: f"coalesce({p}, {neutral[p]})" if p in NUMBERED else neutral[p] for p in READ}
            exists += f" and not ({_has(SPACES['a'])}) and not ({_has(SPACES['b'])})"
        if space == "v":  # kept whole, for the levels
            values = {p: p for p in READ}
        sums = [" + ".join(f"_{p}{k}" for p in mine) + f" as d{k + 1}" for k in ks]
        rows.append(f"if({exists}, struct('{space}' as space, " + ", ".join([*(f"{v} as {p}" for p, v in values.items()), *sums]) + "), null)")
    keep = [c for c in points.columns if c not in READ]
    exploded = own.selectExpr(*keep, f"explode(array({', '.join(rows)})) as s").filter("s is not null").select(*keep, "s.*")
    return exploded.selectExpr("*", f"{_cell('d1')} as cell", f"{_cell('d2')} as cell2")


def _cell(distance: str) -> str:
    """The cell of a distance; vendor and day alone need narrow ones."""
    return f"shiftright({distance}, if(space = 'v', 4, {CELL_BITS}))"




def distance(parts: list[str], most: int = RADIUS) -> str:
    """The true distance to the parts with prefix ``h_``, or more than ``most`` if it is more."""
    return " + ".join(_part_distance(p, p, f"h_{p}", most) for p in parts)


def _within(radius: int) -> str:
    return " and ".join(f"abs({d} - h_{d}) <= {radius}" for d in ("d1", "d2"))


def asked_cells(asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``asked`` once for each cell within ``radius`` of its first two distances."""
    own = [c for c in asked.columns if c not in ("cell", "cell2")]
    reach = lambda d: f"explode(sequence({_cell(f'{d} - {radius}')}, {_cell(f'{d} + {radius}')}))"
    return asked.selectExpr(*own, f"{reach('d1')} as cell").selectExpr("*", f"{reach('d2')} as cell2")


def near_cells(cells: DataFrame, stored: DataFrame, keep: list[str], radius: int = RADIUS, parts: list[str] = list(READ)) -> DataFrame:
    """Each row of ``cells`` with the ``keep`` columns (prefix h_) of all rows of ``stored`` within ``radius``."""
    other = stored.selectExpr("space", "cell", "cell2", *[f"{c} as h_{c}" for c in [*parts, "d1", "d2", *keep]])
    pruned = cells.join(other, ["space", "cell", "cell2"]).filter(_within(radius))
    return pruned.filter(f"{distance(parts, radius)} <= {radius}")


def near_places(asked: DataFrame, stored: DataFrame, keep: list[str], radius: int = RADIUS) -> DataFrame:
    """The same for rows that don't stand in all their cells yet."""
    return near_cells(asked_cells(asked, radius), stored, keep, radius)


# ---- the history -----------------------------------------------------------------------------------
#: Columns of the history: a place with its distances, the point's key, its document and that one's first batch, and whether it has no number, and no document but itself.
_STORED = ["space", *READ, "d1", "d2", "id", "document", "batch", "lost", "open"]


class History:
    """The stored table of distances under ``path``: pivots, bounds of ranges, and places by range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pivots")
        self.exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        if self.exists:
            kept = spark.read.parquet(f"{path}/pivots").first()
            self.pivots, self.bounds = [p.asDict() for p in kept["pivots"]], list(kept["bounds"])

    def start(self, points: DataFrame, ranges: int = RANGES) -> None:
        """Fixes the pivots, and the bounds of the ranges by quantiles of the distances of a bounded sample."""
        self.pivots = choose_pivots(points)
        some = points.orderBy(F.xxhash64("id")).limit(RANGE_SAMPLE)
        cells = measured(some, STORED_SPACES, self.pivots).agg(F.percentile_approx("cell", [k / ranges for k in range(1, ranges)], 1000)).first()[0]
        self.bounds = sorted(set(cells or []))
        shape = "pivots array<struct<" + ",".join(f"{c}:{k}" for c, k in READ.items()) + ">>, bounds array<long>"
        self.spark.createDataFrame([(self.pivots, self.bounds)], shape).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots")
        self.exists = True

    def range_of(self, cell: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in self.bounds]).cast("array<long>"), lambda b: b <= cell))

    def reached(self, asked: DataFrame) -> DataFrame | None:
        """The places of the ranges that ``asked`` can reach; the list of ranges has a row for each at most."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/places")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        wanted = [r[0] for r in asked.selectExpr(f"explode(array({_cell(f'd1 - {RADIUS}')}, {_cell(f'd1 + {RADIUS}')})) as c").select(self.range_of(F.col("c"))).distinct().collect()]
        places = self.spark.read.parquet(f"{self.path}/places").filter(F.col("range").isin(wanted) if wanted else F.lit(False))
        return places.selectExpr("*", f"{_cell('d1')} as cell", f"{_cell('d2')} as cell2")

    def append(self, places: DataFrame) -> None:
        own = places.withColumn("range", self.range_of(F.expr(_cell("d1")))).select("range", *_STORED)
        own.repartition("range").sortWithinPartitions("range", "space", "d1").write.partitionBy("range").mode("append").parquet(f"{self.path}/places")


def _folded(places: DataFrame, *of: Column, parts: list[str] = list(READ)) -> DataFrame:
    """One row for each place of a space with ``of`` its rows."""
    return places.groupBy("space", *parts).agg(*of, *[F.min(c).alias(c) for c in ("d1", "d2", "cell", "cell2")])


def link_numbered(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``id, document, since`` of the points of ``new`` (measured in ``SPACES``) that are near others of it or of ``stored``.

    Most points share no cell with any other; only those that do are carried on with all their parts.
    """
    cells = ["space", "cell", "cell2"]
    asked = asked_cells(new.selectExpr("id", "batch", "space", *NUMBERED, "d1", "d2"))
    old = None if stored is None else stored.filter(F.col("space").isin(*SPACES) & ~F.col("lost")).select(*cells, *NUMBERED, "d1", "d2", "document", "batch")
    held = asked.select(*cells, "id")
    if old is not None:
        held = held.unionAll(old.select(*cells, F.col("document").alias("id")))
    met = held.groupBy(*cells).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select(*cells)
    mine = materialise(asked.join(met, cells, "left_semi"), "asked")
    own = mine.filter(f"cell = {_cell('d1')} and cell2 = {_cell('d2')}")
    other = _folded(own, F.min("id").alias("document"), F.min("batch").alias("batch"), parts=NUMBERED)
    if old is not None:
        other = other.unionByName(old.join(met, cells, "left_semi").select(other.columns))
    near = near_cells(mine, other, ["document", "batch"], parts=NUMBERED).filter("id <> h_document")
    near = materialise(near.select("id", "batch", "h_document", "h_batch").distinct(), "near")
    linked = components(near.select(F.col("id").alias("a"), F.col("h_document").alias("b")))
    nodes = near.select("id", "batch").unionAll(near.select("h_document", "h_batch")).groupBy("id").agg(F.min("batch").alias("batch"))
    known = nodes.join(linked, F.col("id") == F.col("node")).select("id", "batch", F.col("component").alias("document"))
    return known.select("id", "document").join(known.groupBy("document").agg(F.min("batch").alias("since")), "document")


def _vicinity(places: DataFrame, asked: DataFrame) -> DataFrame:
    """The places of the space of vendor and day that one asked is near, each once and whole."""
    own = asked_cells(asked.filter("space = 'v'").select("space", "vendor", "day", "d1", "d2").distinct())
    own = own.selectExpr(*[f"{c} as h_{c}" for c in ("cell", "cell2", "vendor", "day", "d1", "d2")])
    true = " + ".join(_part_distance(p, p, f"h_{p}", RADIUS) for p in ("vendor", "day"))
    return places.filter("space = 'v'").join(own, F.expr(f"cell = h_cell and cell2 = h_cell2 and {_within(RADIUS)} and {true} <= {RADIUS}"), "left_semi")


def fit_lost(lost: DataFrame, numbered: DataFrame, pivots: list[dict]) -> DataFrame:
    """``id, any, fit, batch``: whether a numbered document is near each lost point, the only one in the finest level and its batch.

    ``numbered`` has the parts with ``document`` and ``batch``; it is folded to places with their least and greatest document.
    """
    levels = {str(n): fields for n, fields in enumerate(LEVELS)}
    places = _folded(measured(numbered.select(*READ, "document", "batch"), levels, pivots),
                     F.min("document").alias("a"), F.max("document").alias("z"), F.min("batch").alias("since"))
    near = near_places(measured(lost.select("id", *READ), levels, pivots), places, ["a", "z", "since"])
    each = near.groupBy("id", "space").agg(F.min("h_a").alias("a"), F.max("h_z").alias("z"), F.min("h_since").alias("since"))
    return each.groupBy("id").agg(F.min_by(F.struct("a", "z", "since"), "space").alias("s")).select(
        "id", F.lit(True).alias("any"), F.when(F.col("s.a") == F.col("s.z"), F.col("s.a")).alias("fit"), F.col("s.since").alias("since"))


def twin_lost(lost: DataFrame, others: DataFrame, pivots: list[dict]) -> DataFrame:
    """``id, twin, since``: the smallest document among points without number that equal each of ``lost`` in all its fields that count."""
    whole = {"w": list(dict.fromkeys(LEVELS[0]))}
    levels = {str(n): fields for n, fields in enumerate(LEVELS[:TWINS])}

    def bare(frame: DataFrame) -> DataFrame:  # points too bare for any level meet where everything is equal
        filled = frame.withColumns({c: F.coalesce(F.col(c), F.lit("" if k == "string" else -1).cast(k)) for c, k in READ.items()})
        return measured(filled.filter("vendor <> '' and day >= 0"), whole, pivots)

    keep = ["id", "document", "batch"]
    stored = measured(others.select(*keep, *READ), levels, pivots).unionByName(bare(others.select(*keep, *READ)))
    places = _folded(stored, F.min("document").alias("a"), F.min("batch").alias("since"))
    asked = measured(lost.select("id", *READ), levels, pivots)
    finest = asked.groupBy("id").agg(F.min("space").alias("space"))
    asked = asked.join(finest, ["id", "space"]).unionByName(bare(lost.filter(f"not ({_has(LEVELS[TWINS - 1])})").select("id", *READ)).select(asked.columns))
    return near_places(asked, places, ["a", "since"], radius=0).groupBy("id").agg(F.min("h_a").alias("twin"), F.min("h_since").alias("twin_since"))


def check_batch(history: str, batch: DataFrame, ranges: int = RANGES, last: bool = False) -> DataFrame:
    """``prior_key, doc_key`` of the rows of ``batch`` whose document came in a smaller batch, then appends it to ``history`` unless it is the ``last``.

    ``history`` is a folder in shared storage, empty at first. ``batch`` may hold several batch numbers. Of the history only the ranges that the
    batch's distances reach are read, and never a text.
    """
    spark = batch.sparkSession
    store = History(spark, history)
    rows = materialise(read_identities(batch), "identities")
    points = materialise(fold(rows), "points")
    if not store.exists:
        if points.isEmpty():
            return rows.select(F.col("doc_key").alias("prior_key"), "doc_key").limit(0)
        store.start(points, ranges)
    own = points.withColumn("lost", F.col("letters").isNull())
    table = materialise(measured(own, STORED_SPACES, store.pivots), "distances")
    stored, stages = store.reached(table), []
    numbered = materialise(link_numbered(table.filter("not lost and space <> 'v'"), stored), "numbered")
    # every numbered point with its document, in the space of vendor and day
    here = table.filter("not lost and space = 'v'").withColumnRenamed("batch", "own_batch").join(numbered, "id", "left").withColumns(
        {"document": F.coalesce("document", "id"), "batch": F.coalesce("since", "own_batch")})

    # those without number: near numbered documents of the batch and of the history
    lost = own.filter("lost and vendor is not null and day is not null")
    lost_places = table.filter("lost")
    inside = _vicinity(here, lost_places).select("document", "batch", *READ)
    others = lost.select("id", F.col("id").alias("document"), "batch", *READ)
    extra = None
    if stored is not None:
        full = _vicinity(stored, lost_places)
        inside = inside.unionByName(full.filter("not lost").select("document", "batch", *READ))
        others = others.unionByName(full.filter("lost").select("id", "document", "batch", *READ))
        # and the history's own, so far alone, for which the batch has the number
        beside = materialise(_vicinity(here, stored.filter("lost and open")), "beside")
        alone = _vicinity(stored.filter("lost"), beside)
        alone = alone.groupBy("id", *READ).agg(F.min("document").alias("document"), F.min("batch").alias("batch"), F.min("open").alias("open")).filter("open")
        extra = fit_lost(alone, beside.select("document", "batch", *READ), store.pivots).filter("fit is not null")
        stages.append(beside)
        extra = materialise(extra.join(alone.select("id", "document", F.col("batch").alias("own_batch"), *READ), "id"), "extra")
        stages.append(extra)
    # written one by one, so that the driver plans and runs the joins of one at a time
    fits = materialise(fit_lost(lost, inside, store.pivots), "fits")
    twins = materialise(twin_lost(lost, others, store.pivots), "twins")
    stages += [fits, twins]
    settled = lost.join(fits, "id", "left").join(twins, "id", "left").select(
        "id", "batch", *READ, F.coalesce("fit", F.when(F.col("any"), F.col("id")), "twin", "id").alias("document"),
        F.least("batch", F.when(F.col("fit").isNotNull(), F.col("since")).when(F.col("any").isNull(), F.col("twin_since"))).alias("since"), F.col("any").isNull().alias("open"))
    settled = materialise(settled, "settled")
    placed = own.filter("not lost").select("id", "batch").join(numbered, "id", "left").select("id", F.coalesce("document", "id").alias("document"), F.coalesce("since", "batch").alias("since"))
    everything = placed.unionAll(settled.select("id", "document", "since"))
    groups = everything.select("document", F.col("id").alias("key"), "since")
    if extra is not None:
        groups = groups.unionAll(extra.select(F.col("fit").alias("document"), F.col("document").alias("key"), F.col("own_batch").alias("since")))
    first = groups.groupBy("document").agg(F.least(F.min("document"), F.min("key")).alias("prior_key"), F.min("since").alias("prior_batch"))
    known = materialise(everything.select("id", "document").join(first, "document").select("id", "prior_key", "prior_batch"), "known")
    places = own.select("point", "id")
    found = rows.select("doc_key", "batch_no", "point").join(places.join(known, "id"), "point").filter("batch_no > prior_batch").select("prior_key", "doc_key")
    found = materialise(found, "found")
    if last:  # nothing asks the history again
        discard(rows, points, table, numbered, settled, known, *stages)
        return found
    final = known.select("id", F.col("prior_key").alias("document"), F.col("prior_batch").alias("batch"))
    opened = settled.select("id", "open")
    fresh = table.drop("batch").join(final, "id").join(opened, "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    fresh = fresh.select(*_STORED)
    if extra is not None:
        closed = measured(extra.select("id", F.col("fit").alias("document"), F.col("own_batch").alias("batch"), F.lit(True).alias("lost"), F.lit(False).alias("open"), *READ),
                          {"v": STORED_SPACES["v"]}, store.pivots)
        fresh = fresh.unionByName(closed.select(*_STORED))
    store.append(fresh)
    discard(rows, points, table, numbered, settled, known, *stages)
    return found


def resubmissions(docs: DataFrame) -> DataFrame:
    """``prior_key, doc_key`` of every row whose document was in a smaller batch.

    Batch 0 fills the table of distances; the later batches are checked against it, all in one call.
    """
    spark = docs.sparkSession
    history = os.path.join(shared_dir(spark), f"history-{uuid.uuid4().hex}")
    number = F.coalesce(F.col("batch_no").cast("int"), F.lit(0))
    check_batch(history, docs.filter(number <= 0))
    return check_batch(history, docs.filter(number > 0), last=True)
