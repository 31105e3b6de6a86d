"""Problem 6: spellings of one firm or person, typed by people, linked to each other.

Each distinct spelling is read once: legal form and trade word (also abbreviated) come off, given
names are brought to their formal form, and what remains are its own words: full words, initials,
words without vowels, shortened possessives, or two words run together. The full words go into
tries, sharded by their first and last letters; a Levenshtein automaton (with transpositions)
walks each trie and enumerates the neighbours of every word. Spellings that share a neighbouring
word, and the initial of their other word, are compared token by token in either order. Links form
components; a spelling with only an initial joins a component if just one fits.

Defined results
  * null and blank names: no rows. Names without a letter or digit: linked to nothing.
  * each distinct string counts once, however often it stands in either table.
  * words of more than ``LONG_WORD`` or fewer than ``SHORT_WORD`` letters are only compared as equal.
  * given names and trade words are the fixed lists below; a short form outside them links only by its letters.
  * a shard that outgrows ``SHARD_WORDS`` is cut into several tries that each query walks.
  * pairs come out for whole components (the pairs are the result); candidates are only formed
    within equal word, other initial and trade, by joins that adaptive execution splits.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.graph import components
from ledgerloom.session import materialise

SHARD_WORDS = 20_000
#: Words beyond this length are only compared as equal.
LONG_WORD = 64
#: Words of fewer letters have too many neighbours to be one of them; they meet where they are equal.
SHORT_WORD = 4

# Legal forms.
LEGAL = {"AG", "BV", "CO", "COMPANY", "CORP", "CORPORATION", "GMBH", "INC", "KG", "LLC", "LLP", "LTD", "LIMITED", "NV", "OY", "PLC", "PTY", "SA", "SARL", "SAS", "SPA", "SRL"}
# Trade words.
TRADES = [
    "AGRICULTURE", "ARCHITECTS", "ASSOCIATES", "AUTOMOTIVE", "BAKERY", "BREWING", "BROTHERS", "CARPENTRY", "CATERING", "CERAMICS", "CHEMICALS", "CLEANING",
    "COMMUNICATIONS", "CONSTRUCTION", "CONSULTING", "DISTRIBUTION", "ELECTRICAL", "ELECTRONICS", "ENGINEERING", "ENTERPRISES", "FISHERIES", "FORWARDING",
    "FOUNDRY", "FURNITURE", "GARDENING", "GROCERS", "HARDWARE", "HOLDINGS", "INDUSTRIES", "INSTRUMENTS", "INSURANCE", "INTERNATIONAL", "INVESTMENTS", "JEWELLERS",
    "LABORATORIES", "LANDSCAPING", "LAUNDRY", "LOGISTICS", "MACHINERY", "MAINTENANCE", "MANUFACTURING", "MARKETING", "MINERALS", "OPTICIANS", "PACKAGING",
    "PAINTING", "PARTNERS", "PHARMACEUTICALS", "PLASTICS", "PLUMBING", "PRINTING", "PROPERTIES", "PUBLISHING", "RECYCLING", "REFRIGERATION", "ROOFING", "SERVICES",
    "SHIPPING", "SOLUTIONS", "SYSTEMS", "TECHNOLOGIES", "TEXTILES", "TRADING", "TRANSPORT", "VENTURES", "WAREHOUSING", "WHOLESALE", "WOODWORKS",
]
# Other forms of trade words that aren't made of their letters in order.
TRADE_FORMS = {"PRINTERS": "PRINTING", "CATERERS": "CATERING", "ENGINEERS": "ENGINEERING", "LABORATORY": "LABORATORIES"}
# Given names and their short forms.
GIVEN = {
    "ABIGAIL": ["ABBY", "GAIL"], "ALBERT": ["AL", "ALBIE"], "ALEXANDER": ["ALEX", "ALEC", "SANDY", "SASHA", "XANDER"], "ANDREW": ["ANDY", "DREW"], "ANTHONY": ["TONY", "ANTON"],
    "ARTHUR": ["ART", "ARTIE"], "BARBARA": ["BARB", "BABS"], "BENJAMIN": ["BEN", "BENNY"], "CAROLINE": ["CARRIE", "CARO"], "CATHERINE": ["CATHY", "CAT"],
    "CHARLES": ["CHARLIE", "CHUCK", "CHAS"], "CHRISTINA": ["TINA", "CHRISSY"], "CHRISTOPHER": ["CHRIS", "KIT", "TOPHER"], "DANIEL": ["DAN", "DANNY"], "DAVID": ["DAVE", "DAVY"],
    "DOROTHY": ["DOT", "DOTTY", "DOLLY", "DORA"], "EDWARD": ["ED", "EDDIE", "NED"], "ELEANOR": ["ELLIE", "NORA"],
    "ELIZABETH": ["LIZ", "LIZZY", "BETTY", "BETH", "ELIZA", "LISA"], "FRANCISCO": ["PACO", "PANCHO", "CISCO", "KIKO"], "FREDERICK": ["FRED", "FREDDY"],
    "GEOFFREY": ["GEOFF"], "GIUSEPPE": ["BEPPE", "PEPPE", "PINO", "GEPPE"], "GREGORY": ["GREG"], "HELENA": ["LENA", "NELL", "HELEN", "NELLY"], "JACQUELINE": ["JACKIE"],
    "JAMES": ["JIM", "JIMMY", "JAMIE"], "JENNIFER": ["JEN", "JENNY"], "JOHANNES": ["HANS", "HANNES", "JOHANN", "JAN"], "JONATHAN": ["JON", "JONNY"], "JOSEPH": ["JOE", "JOEY"],
    "JOSHUA": ["JOSH"], "KATHERINE": ["KATE", "KATHY", "KATIE", "KAY", "KIT"], "KENNETH": ["KEN", "KENNY"], "LAWRENCE": ["LARRY", "LAURIE"],
    "MARGARET": ["PEGGY", "MAGGIE", "MEG", "GRETA", "MARGE"], "MATTHEW": ["MATT"], "MICHAEL": ["MIKE", "MICK", "MICKEY"], "NATALIA": ["NATASHA", "TALIA"],
    "NICHOLAS": ["NICK", "KLAUS", "NICKY", "NICO"], "PATRICIA": ["PAT", "PATTY", "TRICIA", "TRISH"], "PATRICK": ["PADDY", "RICKY"], "PETER": ["PETE"], "PHILIP": ["PHIL", "PIP"],
    "REBECCA": ["BECKY", "BECCA"], "RICHARD": ["DICK", "RICK", "RICH", "RICKY"], "ROBERT": ["BOB", "BOBBY", "ROB", "ROBBIE", "BERT"], "RONALD": ["RON", "RONNIE"],
    "SAMUEL": ["SAM", "SAMMY"], "STEPHEN": ["STEVE", "STEVIE"], "SUSANNA": ["SUE", "SUSAN", "SUSIE"], "THEODORE": ["TED", "TEDDY", "THEO"], "THOMAS": ["TOM", "TOMMY"],
    "TIMOTHY": ["TIM", "TIMMY"], "VICTORIA": ["VICKY", "TORI", "VICKI", "VIKKI"], "VINCENT": ["VINCE", "VINNIE"], "WALTER": ["WALT", "WALLY"],
    "WILLIAM": ["BILL", "WILL", "BILLY", "WILLY", "LIAM"], "ZACHARY": ["ZACH", "ZACK"],
}
# a short form of two names stands for the more frequent one, which comes last
_FORMAL = {short: name for name, shorts in GIVEN.items() for short in [name, *shorts]}
_VOWELS = set("AEIOU")


def _in_order(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions of neighbours, or ``most`` + 1 if it is more; linear in length."""
    if a == b:
        return 0
    n, far = len(b), most + 1
    if abs(len(a) - n) > most:
        return far
    two: list[int] = []
    one = [min(j, far) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(n, i + most)
        row = [far] * (n + 1) if n < 64 else dict.fromkeys(range(lo - 2, hi + 2), far)
        if i <= most:
            row[0] = i
        best = row[0] if i <= most else far
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = min(one[j] + 1 if j <= i - 1 + most else far, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row[j] = d
            best = min(best, d)
        if best > most:
            return far
        two, one = one, row
    return min(one[n], far)


def _shorter(word: str) -> list[str]:
    """A word and what is left of it without any one letter; words within one edit have a form in common."""
    return [word, *(word[:i] + word[i + 1:] for i in range(len(word)))]


def _by_form(words) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in words:
        for form in _shorter(w):
            out.setdefault(form, []).append(w)
    return out


_TRADE_FORMS, _GIVEN_FORMS = _by_form(TRADES), _by_form(GIVEN)
_LONGEST = max(map(len, [*TRADES, *GIVEN])) + 1


def _nearly(word: str, forms: dict[str, list[str]]) -> str | None:
    """The word of a fixed list within one edit, the first of the list if there are several."""
    if len(word) > _LONGEST:
        return None
    near = {t for form in _shorter(word) for t in forms.get(form, ()) if edits(word, t, 1) <= 1}
    return min(near) if near else None


def _trade(word: str) -> str | None:
    if word in TRADE_FORMS:
        return TRADE_FORMS[word]
    for t in TRADES:
        if word == t:
            return t
    if len(word) >= 3:
        fits = [t for t in TRADES if word[0] == t[0] and len(word) < len(t) and _in_order(word, t)]
        if fits:  # the one that starts most like it, then the shortest
            return max(fits, key=lambda t: (len(os.path.commonprefix([word, t])), -len(t), t))
    return _nearly(word, _TRADE_FORMS) if len(word) >= 7 else None


def _given(word: str) -> str | None:
    if word in _FORMAL:
        return _FORMAL[word]
    return _nearly(word, _GIVEN_FORMS) if len(word) >= 4 else None


def read(name: str) -> tuple[str, list[tuple[str, str]]]:
    """``(trade, words)`` of a spelling; a word is (kind, letters).

    Kinds: g given name, w full word, i initial, c word without its vowels, p start of a word.
    """
    text = "".join(c for c in unicodedata.normalize("NFKD", name.upper()) if not unicodedata.combining(c))
    text = re.sub(r"\b([A-Z])\.([A-Z])\.(?![A-Z])", r"\1\2 ", text).replace("’", "'")
    text = re.sub(r"(?<=[A-Z])[/](?=[A-Z])", "", re.sub(r"'(?!S\b)", "", text))
    raw = [t for t in re.findall(r"[A-Z0-9]+(?:'S)?", re.sub(r"&|\bAND\b", " ", text)) if t]
    if len(raw) > 2 and raw[-1] in LEGAL or len(raw) == 2 and raw[-1] in LEGAL and len(raw[0]) >= 9:
        raw.pop()
    trade, at = "", None
    for i, t in enumerate(raw):
        if t in TRADES:
            trade, at = t, i
            break
    if at is None and len(raw) >= 2:
        for i in (len(raw) - 1, 0):
            others = [x for k, x in enumerate(raw) if k != i]
            if len(raw[i]) >= 3 and (found := _trade(raw[i])) and any(len(x) > 2 for x in others) and not (len(raw) == 2 and _given(raw[i])):
                trade, at = found, i
                break
    if at is not None:
        raw.pop(at)
    words, person = [], False
    for t in raw:
        if t.endswith("'S"):
            words.append(("p", t[:-2]))
        elif len(t) == 1:
            words.append(("i", t))
        elif not person and (formal := _given(t)) and len(raw) > 1:
            words.append(("g", formal))
            person = True
        elif not _VOWELS & set(t) and len(t) <= 5:
            words.append(("c", t))
        else:
            words.append(("w", t))
    return trade, words


def _fits(x: tuple[str, str], y: tuple[str, str]) -> int | None:
    """Cost of taking two words for one: edits between full words, 0 for a proper short form."""
    (k, a), (m, b) = x, y
    full = "wg"
    if k in full and m in full:
        if k != m:
            return None
        if k == "g":
            return 0 if a == b else None
        d = edits(a, b, 2)
        return d if d <= (2 if min(len(a), len(b)) >= 5 else 1 if min(len(a), len(b)) == 4 else 0) else None
    if k in full or m in full:
        (k, a), (m, b) = ((k, a), (m, b)) if m in full else ((m, b), (k, a))
        if k == "i":
            return 0 if b[0] == a else None
        if m == "g":
            return None
        if k == "p":
            return 0 if b.startswith(a) else None
        return 0 if "".join(c for c in b if c not in _VOWELS) == a else None
    if "i" in (k, m):
        return 0 if a[0] == b[0] else None
    if k == m:
        return 0 if a == b else None
    start, bare = (a, b) if k == "p" else (b, a)
    return 0 if bare.startswith("".join(c for c in start if c not in _VOWELS)) else None


def same(left: tuple[str, list], right: tuple[str, list]) -> bool:
    """Whether two read spellings name one firm or person, words taken in either order."""
    (ta, a), (tb, b) = left, right
    person = any(k == "g" for k, _ in a) or any(k == "g" for k, _ in b)
    if ta != tb and not (person and (not ta or not tb)):
        return False
    if len(a) == 1 and len(b) == 1:
        return a[0][0] == b[0][0] == "w" and len(a[0][1]) >= 5 and edits(a[0][1], b[0][1], 1) <= 1
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1 and len(b) == 2:
        joined = a[0][1]
        if a[0][0] != "w":
            return False
        for full, short in (b, b[::-1]):
            if full[0] == "w" and short[0] in "icp" and len(joined) >= 8 and len(full[1]) >= 4:
                for rest in ({joined[len(full[1]):]} if joined.startswith(full[1]) else set()) | ({joined[:-len(full[1])]} if joined.endswith(full[1]) else set()):
                    if rest and _fits(("w", rest), short) == 0:
                        return True
        if any(k != "w" for k, _ in b):
            return False
        return min(edits(a[0][1], b[0][1] + b[1][1], 2), edits(a[0][1], b[1][1] + b[0][1], 2)) <= 2
    if len(a) != len(b):
        return False
    if len(a) > 2:  # what is equal takes itself out, the rest is tried in every order
        b = list(b)
        a = [x for x in a if not (x in b and not b.remove(x))]
        if len(a) > 4:
            return False
        if not a:
            return True
        agreed = True
    else:
        agreed = False
    for order in permutations(b):
        costs = [_fits(x, y) for x, y in zip(a, order)]
        if None not in costs and sum(costs) <= 2 and (agreed or any(x[0] == y[0] == "w" and c <= 1 for x, y, c in zip(a, order, costs))):
            return True
    return False


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every spelling: a row for each word it can be found by."""
    for batch in batches:
        out: list[tuple] = []
        for name in batch.column(0).to_pylist():
            trade, words = read(name)
            person = any(k == "g" for k, _ in words)
            weak = any(k == "i" for k, _ in words)
            # a person's trade is left out of the key: their own business goes under it
            loose = "" if person or weak and len(words) == 2 and not trade else trade
            kinds = [k for k, _ in words]
            for k, w in words:
                if k == "w" and len(w) >= 2:
                    rest = list(words)
                    rest.remove((k, w))
                    out.append((name, "word", w, loose, "".join(sorted(x[1][0] for x in rest)), weak))
            if kinds == ["w", "w"]:
                out.append((name, "joined", words[0][1] + words[1][1], trade, "", weak))
                out.append((name, "joined", words[1][1] + words[0][1], trade, "", weak))
            elif kinds == ["w"] and len(words[0][1]) >= 8:
                w = words[0][1]
                out.append((name, "joined", w, trade, "", weak))
                for cut in range(4, len(w) - 3) if len(w) <= LONG_WORD else ():
                    out.append((name, "word", w[:cut], trade, w[cut], weak))
                    out.append((name, "word", w[cut:], trade, w[0], weak))
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.string()] * 5 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "space", "word", "trade", "initial", "weak"])


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def walk(root: dict, word: str, most: int) -> list[str]:
    """All words of the trie within ``most`` edits (or transpositions) of ``word``.

    Each trie node carries the automaton's state: the row of distances to the prefixes of ``word``.
    """
    found, n = [], len(word)
    todo = [(root, list(range(n + 1)), None, "")]
    while todo:
        node, row, above, last = todo.pop()
        for c, child in node.items():
            if c == "":
                if row[n] <= most:
                    found.append(child)
                continue
            new = [row[0] + 1]
            for j in range(1, n + 1):
                d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                if above is not None and j > 1 and word[j - 2] == c and word[j - 1] == last:
                    d = min(d, above[j - 2] + 1)
                new.append(d)
            if min(new) <= most:
                todo.append((child, new, row, c))
    return found


def _meeting(w: str, v: str) -> str:
    """The first kind of shard that has both words."""
    if w[:2] == v[:2]:
        return "first"
    if w[-2:] == v[-2:]:
        return "last"
    return "head" if w[0] == v[0] else "tail"


def _trie_join(key: tuple, shard: pa.Table) -> pa.Table:
    """One trie of a shard against one part of the shard's words."""
    space, side = key[0].as_py(), key[1].as_py()
    asked = shard.column("query").to_pylist()
    words = shard.column("word").to_pylist()
    root = build_trie([w for w, q in zip(words, asked) if not q])
    pairs = [
        (w, v)
        for w, q in zip(words, asked) if q
        for v in walk(root, w, 1)
        # a pair that meets in several shards is taken in the first of them
        if w < v and side == _meeting(w, v)
    ]
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"space": pa.array([space] * len(a), pa.string()), "word": pa.array(a, pa.string()), "near": pa.array(b, pa.string())})


def neighbours(words: DataFrame) -> DataFrame:
    """``space, word, near``: all pairs of different words within one edit, both ways round.

    A single edit can't touch both the first two and the last two letters of a word of six or
    more, nor the first and the last letter of a shorter one, so some shard has both. ``words`` has distinct ``space, word``.
    """
    shards = [("first", "left(word, 2)"), ("last", "right(word, 2)")]
    short = [("head", "if(length(word) <= 5, left(word, 1), null)"), ("tail", "if(length(word) <= 5, right(word, 1), null)")]
    sides = words.filter(F.length("word").between(SHORT_WORD, LONG_WORD)).select("space", "word", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.expr(shard).alias("shard")) for side, shard in shards + short])).alias("s")).select(
        "space", "word", "s.side", "s.shard").filter("shard is not null")
    parts = sides.groupBy("space", "side", "shard").agg(F.ceil(F.count("*") / SHARD_WORDS).cast("int").alias("parts"))
    keyed = sides.join(parts, ["space", "side", "shard"])
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    own = keyed.withColumn("own", part)
    stored = own.select("space", "side", "shard", F.col("own").alias("part"), every.alias("turn"), "word", F.lit(False).alias("query"))
    asked = own.select("space", "side", "shard", every.alias("part"), F.col("own").alias("turn"), "word", F.lit(True).alias("query"))
    keys = ["space", "side", "shard", "part", "turn"]
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a walk costs far more than its bytes tell: don't coalesce
    found = stored.unionAll(asked).repartition(tasks, *keys).groupBy(*keys).applyInArrow(_trie_join, "space string, word string, near string")
    found = materialise(found, "near")
    return found.unionAll(found.select("space", F.col("near").alias("word"), F.col("word").alias("near")))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}

    def known(name):
        if name not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[name] = read(name)
        return memo[name]

    for batch in batches:
        keep = [same(known(a), known(b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def link_names(names: DataFrame, column: str = "name") -> DataFrame:
    """``name, component`` of all spellings that are linked to another one."""
    distinct = materialise(names.select(F.col(column).alias("name")).filter("name is not null and trim(name) <> ''").distinct(), "names")
    keys = materialise(distinct.mapInArrow(_read_all, "name string, space string, word string, trade string, initial string, weak boolean"), "keys")
    near = neighbours(keys.select("space", "word").distinct())
    own = keys.select("name", "space", F.col("word").alias("near"), "trade", "initial", "weak")
    reach = own.unionAll(keys.join(near, ["space", "word"]).select("name", "space", "near", "trade", "initial", "weak"))
    other = keys.select(F.col("name").alias("name_2"), "space", F.col("word").alias("near"), "trade", "initial", F.col("weak").alias("weak_2"))
    pairs = reach.join(other, ["space", "near", "trade", "initial"]).filter("name <> name_2")
    pairs = pairs.select(F.least("name", "name_2").alias("a"), F.greatest("name", "name_2").alias("b"),
                         F.when(F.col("name") < F.col("name_2"), F.col("weak")).otherwise(F.col("weak_2")).alias("weak_a"),
                         F.when(F.col("name") < F.col("name_2"), F.col("weak_2")).otherwise(F.col("weak")).alias("weak_b")).distinct()
    links = materialise(pairs.mapInArrow(_judge, "a string, b string, weak_a boolean, weak_b boolean"), "links")
    strong = components(links.filter("not weak_a and not weak_b"))
    firm = distinct.join(strong, F.col("name") == F.col("node"), "left").select("name", F.coalesce("component", "name").alias("component"))
    # a spelling with an initial joins a component only where a single one fits
    side = lambda a, b, wa, wb: links.filter(f"{wa}").select(F.col(a).alias("weak_name"), F.col(b).alias("name"), F.col(wb).alias("other_weak"))
    weak = side("a", "b", "weak_a", "weak_b").unionAll(side("b", "a", "weak_b", "weak_a"))
    fits = weak.filter("not other_weak").join(firm, "name").groupBy("weak_name").agg(F.min("component").alias("a"), F.max("component").alias("z"))
    chosen = materialise(fits, "fits")
    unsure = chosen.filter("a <> z").select("weak_name")
    edges = chosen.filter("a = z").select(F.col("weak_name").alias("a"), F.col("a").alias("b"))
    level = weak.filter("other_weak").join(unsure, "weak_name", "left_anti").join(unsure.select(F.col("weak_name").alias("name")), "name", "left_anti")
    edges = edges.unionAll(level.select(F.col("weak_name").alias("a"), F.col("name").alias("b")))
    edges = edges.unionAll(strong.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(edges).select(F.col("node").alias("name"), "component")


def name_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """``name_1, name_2`` of every two spellings of one firm or person, the smaller string first."""
    linked = materialise(link_names(names, column), "linked")
    return linked.select(F.col("name").alias("name_1"), "component").join(
        linked.select(F.col("name").alias("name_2"), "component"), "component").filter("name_1 < name_2").select("name_1", "name_2")
