"""Variant spellings of names typed by people (problem 2).

A mention is folded (compatibility forms, look-alike letters, case, diacritics,
spaces) and read as a model, an organisation, a person or another name.  Reading
tries the orders in which the tokens may stand (given name first, last or after a
comma; the form of an organisation last or before "of"; any order of the words of
another name) and keeps what must be equal (version and edition, form, given name)
apart from what may be misspelt: the name proper.

Names proper are linked by a trie join.  Names of one group are sharded by their
segments: k edits leave one of 2k+1 segments untouched (a swap touches two), so
neighbours share a shard.  In a shard the names form a trie, which every name
that probes the shard traverses with a Levenshtein automaton (rows of the edit
matrix, swaps being one edit), pruned at the bound.  A shard with many names is
sharded once more by what is left of its names, and one that is still large is
split by its held names, so the trie of a task is bounded; probes stream past it.

Spellings one edit apart are one name.  Two spellings two edits apart are, where
neither belongs to a name with a centre (a spelling with several neighbours or
several written forms): then both miss the spelling that they come from.

Which words are titles, forms or legal suffixes, and which name nobody, is a
:class:`Lexicon`, a parameter of every function here.

Defined results: null, blank and generic mentions name no entity and are in no
pair.  Repeated mentions count once.  An acronym or a middle initial is linked
only where exactly one name fits it.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged, tasks_for

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁАЕОРСУХІВКМНТαοερν", "aeopcyxijsdAEOPCYXIBKMHTaoepv")


def _forms() -> dict[str, str]:
    return {
        "software": "software soft sw",
        "researchinstitute": "researchinstitute researchinst resinst resinstitute ri",
        "university": "university univ uni",
        "laboratories": "laboratories laboratory labs lab",
        "holdings": "holdings holding hldgs",
        "communications": "communications communication comms comm",
        "systems": "systems system sys",
        "technologies": "technologies technology tech",
        "analytics": "analytics analytic anlytcs",
        "semiconductor": "semiconductor semiconductors semicon semi",
    }


@dataclass(frozen=True)
class Lexicon:
    """The words that are no part of a name proper, folded; the defaults are those of the project's domain.

    forms: each form of an organisation with its spellings; initials: what a form
    adds to an acronym, its first letter unless named here; legal, before_organisation,
    before_model, titles: what may stand after or before a name, as alternatives of a
    regular expression; generic: words that name nobody.
    """

    forms: dict[str, str] = field(default_factory=_forms)
    initials: dict[str, str] = field(default_factory=lambda: {"researchinstitute": "ri"})
    legal: str = "co ltd|co|ltd|inc|llc|jsc|corp|corporation|group|plc|gmbh"
    before_organisation: str = "cong ty co phan|cong ty tnhh|cong ty|cty cp|cty|ctcp|tap doan|hang|the"
    before_model: str = "mo hinh|model|the model"
    titles: str = "ts|gs|pgs|ths|prof|professor|mr|mrs|ms|dr|ceo|cto|ong|ba"
    generic: frozenset = frozenset(
        "the a an its his her their this that these it they he she we model models lab company startup founder firm chatbot platform user users researchers group"
        " nay nen tang nguoi dung tap doan ong ba ho cong ty mo hinh hang cac nha nghien cuu startup do ay".split()
    )

    def spellings(self) -> dict[str, str]:
        return {x: k for k, v in self.forms.items() for x in v.split()}

    def initial(self, form: str) -> str:
        return self.initials.get(form, form[:1])


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).translate(LOOK_ALIKE).casefold()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Mn", "Cf")).replace("đ", "d").replace("ı", "i")
    s = re.sub(r"[“”„«»]", '"', s)
    return re.sub(r"\s+", " ", s).strip(' "\'')


def _letters(s: str) -> str:
    """The letters of a word, digits read as the letters they look like."""
    return re.sub(r"[^a-z]", "", s.translate(str.maketrans("01358", "olesb"))) or re.sub(r"\W", "", s)


#: Words of another name up to which every order is tried; of more words only one.
ORDERS_UP_TO = 3


class Reader:
    """Reads mentions; ``given``: each given name and short form with its given name."""

    def __init__(self, given: dict[str, str], lexicon: Lexicon | None = None):
        self.given, self.words = given, lexicon or Lexicon()
        full = set(given.values())
        self.initial = {i: g for i in {g[0] for g in full} for g in full if g[0] == i and sum(x[0] == i for x in full) == 1}
        self.forms = self.words.spellings()
        # One trie each, traversed once for a word that is misspelt.
        self.near_given = Trie([w for w in given if len(w) > 4])
        self.near_form = Trie([w for w in self.forms if len(w) > 6])

    def _given(self, w: str) -> str | None:
        w = w.strip(".")
        return self.given.get(w) or (self.initial.get(w) if len(w) == 1 else None)

    def _person(self, s: str) -> dict | None:
        s = re.sub(rf"^(?:(?:{self.words.titles})\.? )+", "", s)
        s = re.sub(r'"[^"]*" ?', "", s).strip(" .")
        # Orders of the tokens: as written, and with the last part first.
        orders = [m[2] + " " + m[1]] if (m := re.fullmatch(r"([^,]+), ?([^,]+)", s)) else [s]
        words = re.split(r"[ -]+", orders[0])
        if len(words) < 2:
            return None
        for ws in (words, words[-1:] + words[:-1]):
            g, rest = self._given(ws[0]), ws[1:]
            if not g:
                continue
            if len(rest) == 2 and re.fullmatch(r"[a-z]\.?", rest[0]):
                return {"kind": "middle", "part": f"P|{g}|{rest[0][0]}", "name": _letters(rest[1])}
            rest = [_letters(w) for w in rest]
            return {"kind": "name", "part": f"P|{g}", "name": "".join(rest), "first": rest[0] if len(rest) == 2 else None, "last": rest[1] if len(rest) == 2 else None}
        for ws in (words, words[-1:] + words[:-1]):
            close = {self.given[w] for w, _ in self.near_given.within(ws[0], 1)}
            if len(close) == 1 and len(ws) == 3:
                rest = [_letters(w) for w in ws[1:]]
                return {"kind": "name", "part": f"P|{close.pop()}", "name": "".join(rest), "first": rest[0], "last": rest[1]}
        return None

    def _model(self, s: str) -> dict | None:
        s = re.sub(rf"^(?:{self.words.before_model}) ", "", s)
        m = re.fullmatch(r"(.*[a-z].*?)(?:[ -]+\(?v?|\(v?)(\d+(?:\.\d+)*)(?:[ -]+([a-z]+))?\)?\.?", s)
        if not m:
            return None
        version = re.sub(r"(\.0)+$", "", m[2])
        return {"kind": "name", "part": f"M|{version}|{m[3] or ''}", "name": _letters(m[1])}

    def _organisation(self, s: str) -> dict | None:
        s = re.sub(r" ?\([a-z]{2,6}\)", "", s)
        s = re.sub(r"[.,]", " ", s)
        s = re.sub(r"\s+", " ", s).strip()
        s = re.sub(rf"^(?:{self.words.before_organisation}) ", "", s)
        s = re.sub(rf"(?: (?:{self.words.legal}))+$", "", s)
        found = None
        if m := re.fullmatch(r"(.+?) of (.+)", s):
            if f := self.forms.get(m[1].replace(" ", "")):
                found = (f, m[2])
        words = re.split(r"[ -]+", s)
        for n in (2, 1):
            if not found and len(words) > n and (f := self.forms.get("".join(words[-n:]))):
                found = (f, " ".join(words[:-n]))
        if not found and len(words) > 1 and len(words[-1]) > 6:
            close = {self.forms[x] for x, _ in self.near_form.within(_letters(words[-1]), 1)}
            if len(close) == 1:
                found = (close.pop(), " ".join(words[:-1]))
        if not found:
            return None
        rest = [_letters(w) for w in re.split(r"[ -]+", found[1])]
        return {"kind": "name", "part": f"O|{found[0]}", "name": "".join(rest), "first": rest[0] if len(rest) == 2 else None, "last": rest[1] if len(rest) == 2 else None}

    def read(self, mention: str) -> list[dict]:
        s = fold(mention)
        words = re.findall(r"\w+", s)
        if not words or all(w in self.words.generic for w in words):
            return []
        if re.fullmatch(r"\s*[A-Z]{2,6}\s*", mention):
            return [{"kind": "acronym", "part": "", "name": s}]
        r = self._model(s) or self._organisation(s) or self._person(s)
        if r is not None:
            out = [r]
        else:
            # Another name: every order of its words is looked up, so that an edit may stand in any word.
            letters = sorted(_letters(w) for w in words)
            orders = itertools.permutations(letters) if len(letters) <= ORDERS_UP_TO else [letters]
            out = [{"kind": "name", "part": "N", "name": n} for n in sorted({"".join(o) for o in orders})]
        if r is not None and r["kind"] == "name" and "rn" in r["name"]:
            # "rn" may stand for "m"; the name is then read both ways.
            out.append(r | {"name": r["name"].replace("rn", "m"), "first": None, "last": None})
        return [x for x in out if x["kind"] != "name" or x["name"]]


class Trie:
    """Names as a trie of dicts; the empty key holds a name that ends there."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for n in names:
            node = self.root
            for c in n:
                node = node.setdefault(c, {})
            node[""] = n

    def within(self, word: str, bound: int) -> Iterator[tuple[str, int]]:
        """(name, edits) of all names within the bound: the automaton's state is a row of the edit matrix."""
        n, far = len(word), bound + 1
        # Per node: children, last letter, the two rows above and their least value, depth.
        stack = [(self.root, "", None, [*range(far), *[far] * (n + 1 - far)], 0, 0)]
        while stack:
            node, last, before, row, least_above, depth = stack.pop()
            depth += 1
            # Outside of the diagonal band every value is above the bound.
            low, high = max(1, depth - bound), min(n, depth + bound)
            for c, child in node.items():
                if c == "":
                    if row[n] <= bound:
                        yield child, row[n]
                    continue
                now = [far] * (n + 1)
                if depth <= bound:
                    now[0] = depth
                least, left = now[0], now[low - 1]
                for j in range(low, high + 1):
                    if word[j - 1] == c:
                        v = row[j - 1]
                    else:
                        v = row[j - 1]
                        if row[j] < v:
                            v = row[j]
                        if left < v:
                            v = left
                        v += 1
                        if before is not None and j > 1 and last == word[j - 1] and c == word[j - 2] and before[j - 2] + 1 < v:
                            v = before[j - 2] + 1
                    now[j] = left = v
                    if v < least:
                        least = v
                # A swap may still gain one on the row above.
                if least <= bound or least_above < bound:
                    stack.append((child, c, row, now, least, depth))


#: Rows of shards that one task sorts and matches.
TASK_ROWS = 60_000
#: Names of a shard from which it is sharded again; the largest trie of a task.
HOT = 4000


def _shards(df: DataFrame, bound: int, lengths: range | None, rest: bool = False) -> DataFrame:
    """(part, name, path[, rest]) of the shards of each row's ``rest``: path is a number made of the path before and the length, number and text of the segment.

    Held names (no lengths) stand in each of their segments' shards.  A probe looks for
    every segment that a name of one of the lengths around its own may share with it,
    and so may lie up to ``bound`` places off.  ``rest``: with what the segment leaves.
    """
    n = 2 * bound + 1
    size = F.length("rest")
    edge = lambda i, length: F.floor(F.lit(i) * length / n).cast("int")

    def shard(length, i, start, end):
        path = F.xxhash64("path", length, F.lit(i), F.substring(F.col("rest"), start + 1, end - start))
        if not rest:
            return path
        left = F.concat(F.substring(F.col("rest"), F.lit(1), start), F.substring(F.col("rest"), end + 1, size))
        return F.struct(path.alias("path"), left.alias("rest"))

    if lengths is None:
        ways = [shard(size, i, edge(i, size), edge(i + 1, size)) for i in range(n)]
    else:
        ways = []
        for delta in lengths:
            of = size + delta
            for i in range(n):
                for shift in range(-bound, bound + 1):
                    start, end = edge(i, of) + shift, edge(i + 1, of) + shift
                    ways.append(F.when((of >= 0) & (start >= 0) & (end <= size), shard(of, i, start, end)))
    d = df.select("part", "name", F.explode(F.array_distinct(F.array_compact(F.array(*ways)))).alias("path"))
    return d.select("part", "name", "path.*") if rest else d


def trie_join(names: DataFrame, bound: int, other: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(part, a, b, edits) of the pairs of different names of one part within the bound.

    names: part, name, distinct.  With ``other`` the pairs are (a of names, b of
    other) and equal names count too.  Shards with more than ``hot`` names are
    sharded again by the rest of their names, which is within the bound as well.
    """
    ordered = other is None
    begin = lambda d: d.select("part", "name", F.xxhash64("part").alias("path"), F.col("name").alias("rest"))
    # A probe of length L meets names of length L-bound..L (both ways: ..L+bound).
    lengths = range(-bound, 1 if ordered else bound + 1)
    of_held, of_probes = begin(names if ordered else other), begin(names)
    d, p = _shards(of_held, bound, None), _shards(of_probes, bound, lengths)
    big = staged(d.groupBy("path").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("path"), "hot")
    piece = None
    if not big.isEmpty():

        def again(flat: DataFrame, begun: DataFrame, more: range | None) -> DataFrame:
            deeper = _shards(_shards(begun, bound, more, True).join(big, "path", "left_semi"), bound, more)
            return flat.join(big, "path", "left_anti").unionByName(deeper)

        d, p = staged(again(d, of_held, None), "held"), again(p, of_probes, lengths)
        # What is still large is split by its held names; every probe goes to each piece.
        salts = staged(d.groupBy("path").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("path", F.ceil(F.col("c") / hot).cast("int").alias("s")), "pieces")
        d = d.join(salts, "path", "left").select("path", "part", "name", F.pmod(F.xxhash64("name"), F.coalesce("s", F.lit(1))).cast("int").alias("piece"))
        p = p.join(salts, "path", "left").select("path", "part", "name", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)).alias("piece"))
        piece = F.xxhash64("path", "piece")
    rows = names.count() * (2 * bound + 1) * (1 + 2 * len(lengths))
    # Where two shards have one number they share a trie per part, and only names of one part meet.
    row = lambda x, side: x.select((F.col("path") if piece is None else piece).alias("shard"), F.lit(side).cast("tinyint").alias("side"), "part", "name")
    both = row(d, 0).unionByName(row(p, 1))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        tries: dict[str, Trie] = {}
        last, found = None, set()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "a", "b", "edits"])

        for b in batches:
            for shard, side, part, w in zip(*[c.to_pylist() for c in b.columns]):
                if shard != last:
                    known, tries, last = {}, {}, shard
                if not side:
                    known.setdefault(part, []).append(w)
                    continue
                own = known.get(part)
                # A shard that holds nothing but the name that probes it has no pair.
                if own is None or ordered and len(own) == 1 and own[0] == w:
                    continue
                if part not in tries:
                    tries[part] = Trie(own)
                for x, e in tries[part].within(w, bound):
                    if not ordered:
                        found.add((part, w, x, e))
                    elif x != w:
                        found.add((part, w, x, e) if w < x else (part, x, w, e))
            if len(found) > 50_000:
                yield flush()
                found.clear()
        yield flush()

    ready = both.repartition(tasks_for(rows, TASK_ROWS, 1), "shard").sortWithinPartitions("shard", "side")
    return ready.mapInArrow(match, "part string, a string, b string, edits int").distinct()


def _merge(df: DataFrame) -> DataFrame:
    """df for a join whose sides both grow with the data: sorted and merged, never broadcast by its size of today."""
    return df.hint("merge")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component.

    Labels take the least label around them and then that label's own label, until
    nothing changes; each round is written to the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    # A label only ever falls, so the rounds end, and they end when nothing changes.
    while True:
        around = _merge(both).join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        lower = _merge(labels).join(around, labels.node == around.n).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        own = labels.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = staged(_merge(lower).join(own, lower.root == own.r, "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.filter("root <> old").limit(1).count():
            return _merge(nodes).join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _known_givens(given_forms: DataFrame, limit: int = 100_000) -> dict[str, str]:
    """The list of given names is a fixed small table; a larger one is refused."""
    rows = given_forms.select("given_name", "short_form").filter("given_name is not null").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many given names for a list")
    out = {fold(r[1]): fold(r[0]) for r in rows if r[1]}
    return out | {fold(r[0]): fold(r[0]) for r in rows}


def link_names(mentions: DataFrame, given_forms: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(mention, entity) of every different mention that names an entity; column ``mention`` in."""
    givens, lexicon = _known_givens(given_forms), lexicon or Lexicon()
    m = mentions.select("mention").filter("trim(mention) <> ''").distinct()
    fields = ["kind", "part", "name", "first", "last"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(givens, lexicon)
        for b in batches:
            rows = [(x, *(r.get(f) for f in fields)) for x in b["mention"] for r in reader.read(x)]
            yield pd.DataFrame(rows, columns=["mention", *fields])

    parsed = staged(m.repartition(F.col("mention")).mapInPandas(read, "mention string, kind string, part string, name string, first string, last string"), "mentions")
    node = F.concat_ws("\u0001", "part", "name").alias("node")
    rows = parsed.filter("kind = 'name'").select("*", node)
    names = staged(rows.groupBy("node", "part", "name").agg(F.count("*").alias("written")), "names")
    as_edge = lambda e: e.select(F.concat_ws("\u0001", "part", "a").alias("a"), F.concat_ws("\u0001", "part", "b").alias("b"))

    near1 = as_edge(trie_join(names.select("part", "name"), 1))
    # A mention that is read in several ways joins their names.
    ways = rows.groupBy("mention").agg(F.min("node").alias("a"), F.collect_set("node").alias("n")).filter(F.size("n") > 1).select("a", F.explode("n").alias("b")).filter("a <> b")
    edges1 = staged(near1.unionByName(ways).distinct(), "near1")
    first = components(names.select("node"), edges1)
    degree = edges1.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = staged(_merge(names).join(first, "node").join(_merge(degree), "node", "left").select("node", "part", "name", "root", "written", F.coalesce("degree", F.lit(0)).alias("degree")), "known")
    centred = known.groupBy("root").agg(F.max((F.col("degree") >= 2) | (F.col("written") >= 3)).alias("centred"))
    loose = _merge(known).join(centred.filter("not centred").select("root"), "root", "left_semi")
    near2 = as_edge(trie_join(staged(loose.select("part", "name"), "loose"), 2))
    # The second round joins the first round's components, not their nodes again.
    of = known.select("node", "root")
    between = _merge(near2).join(of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(_merge(of.select(F.col("node").alias("b"), F.col("root").alias("rb"))), "b")
    merged = components(of.select(F.col("root").alias("node")).distinct(), between.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b"))
    roots = _merge(of).join(merged.select(F.col("node").alias("root"), F.col("root").alias("final")), "root").select("node", F.col("final").alias("root"))
    entity = staged(_merge(rows).join(roots, "node").groupBy("mention").agg(F.min("root").alias("entity")), "entities")

    # Middle initials: the one name of the given name whose first word has the
    # initial and whose last word is within an edit.
    spaced = _merge(rows.filter("first is not null")).join(entity, "mention").select("part", "first", "last", "entity", "node")
    lasts = spaced.filter("part like 'P|%'").select(F.concat_ws("|", "part", F.substring("first", 1, 1)).alias("part"), F.col("last").alias("name"), "entity").distinct()
    middles = parsed.filter("kind = 'middle'").select("mention", "part", "name")
    hits = trie_join(middles.select("part", "name").distinct(), 1, lasts.select("part", "name").distinct())
    fit = middles.join(hits, (middles.part == hits.part) & (middles.name == hits.a)).select("mention", middles.part, hits.b.alias("name")).join(lasts, ["part", "name"])
    fit = fit.groupBy("mention").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).filter("entity = other").select("mention", "entity")
    alone = middles.join(fit, "mention", "left_anti").select("mention", F.concat_ws("\u0001", F.lit("middle"), "part", "name").alias("entity"))

    # Acronyms: initials of the two words and of the form, alone or with the third
    # letter of the second word, of each organisation's best supported spelling.
    best = _merge(spaced.filter("part like 'O|%'")).join(known.select("node", "degree", "written"), "node").groupBy("entity").agg(F.max_by(F.struct("part", "first", "last"), F.struct("degree", "written", "node")).alias("s")).select("entity", "s.*")
    form = reduce(lambda c, k: F.when(F.col("part") == f"O|{k}", lexicon.initial(k)).otherwise(c), lexicon.forms, F.lit(""))
    base = F.concat(F.substring("first", 1, 1), F.substring("last", 1, 1), form)
    short = best.select("entity", F.explode(F.array(base, F.concat(base, F.substring("last", 3, 1)))).alias("name"))
    sole = short.groupBy("name").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).filter("entity = other").select("name", "entity")
    letters = parsed.filter("kind = 'acronym'").select("mention", "name").join(sole, "name", "left").select("mention", F.coalesce("entity", F.concat_ws("\u0001", F.lit("acronym"), "name")).alias("entity"))
    return reduce(DataFrame.unionByName, [entity, fit, alone, letters])


def name_pairs(linked: DataFrame, hot: int = 2000) -> DataFrame:
    """(mention_a, mention_b) of different mentions of one entity, a before b by code points.

    The pairs are the result asked for, so their number is what it is; link_names has
    an entity per mention.  The pairs of an entity with more than ``hot`` mentions are
    made in pieces, each mention standing first in one piece.
    """
    linked = staged(linked.distinct(), "linked")
    sizes = linked.groupBy("entity").agg(F.ceil(F.count("*") / hot).cast("int").alias("s"), F.count("*").alias("c")).filter("c > 1").select("entity", "s")
    d = _merge(linked).join(sizes, "entity")
    a = d.select("entity", F.pmod(F.xxhash64("mention"), F.col("s")).cast("int").alias("piece"), F.col("mention").alias("mention_a"))
    b = d.select("entity", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("piece"), F.col("mention").alias("mention_b"))
    return _merge(a).join(b, ["entity", "piece"]).filter("mention_a < mention_b").select("mention_a", "mention_b")


def all_mentions(claims: DataFrame, mappings: DataFrame) -> DataFrame:
    parts = [claims.select(F.col(c).alias("mention")) for c in ("subject_mention", "object_mention")] + [mappings.select("mention")]
    return reduce(DataFrame.unionByName, [p.distinct() for p in parts])


def found(spark: SparkSession, claims: DataFrame, mappings: DataFrame, given_forms: DataFrame) -> DataFrame:
    return name_pairs(link_names(all_mentions(claims, mappings), given_forms))
