"""Template mining: lines of one shape get one template.

A tree of fixed depth, keyed by the number of tokens and then by leading tokens, leads
to a few candidate templates; a line joins the most similar one if enough of the
comparable (fixed on both sides) tokens agree, and slots that differ become wildcards;
otherwise it is a template of its own.

Templates only meet within one scope and one token count, so those are the groups, and
lines go in arrival order. What a group sees first are the distinct masked lines with
their first and last arrival and number, aggregated before the shuffle: its size is the
number of shapes, not of lines, however hot a count is. Each line then has the text that
its template had at its own arrival. That is what a replay of every line gives, as long
as a repeat joins its first template again and so changes nothing: the way through the
tree only changes where a node gets a child, and a template that agrees with a line in
all comparable slots goes on doing so. A group in which a repeat might do otherwise (see
`_settled`) is replayed line by line, in one ordered pass. `exact=False` spares all that:
each masked line keeps what it got at its first arrival.

A leaf may hold very many templates, as free text makes. A line then meets those that may
be similar enough and no others: of the blocks that the tokens are cut into there are more
than tokens may differ, so such a template has a block in common with the line, or too few
blocks without placeholders to tell. What is met is compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shape_hash_of
from ..functions.masking import MARK, WILD, is_placeholder, mask_key, split_key
from ..scratch import kept
from ..shipping import ship


@dataclass(frozen=True)
class MinerConfig:
    depth: int = 4
    max_children: int = 100
    similarity: float = 0.9
    max_templates: int | None = 10_000  # None: as many as there are


@dataclass
class Template:
    number: int
    tokens: list[str]
    lineage_id: int
    count: int = 0
    first_ns: int = 0
    last_ns: int = 0

    @property
    def text(self) -> str:
        return " ".join(self.tokens)


@dataclass
class _Node:
    children: dict = field(default_factory=dict)
    templates: list[int] = field(default_factory=list)
    places: dict[int, int] = field(default_factory=dict)  # of the templates in that list
    blocks: dict[int, list[int]] = field(default_factory=dict)  # places by the hash of a block
    literal: list[int] = field(default_factory=list)  # by place: how many blocks have no placeholder
    by_literal: dict[int, dict[int, None]] = field(default_factory=dict)  # and the places by that number


def similarity(template: list[str], tokens: list[str]) -> float:
    """The share of comparable positions that agree; 1 if none is comparable."""
    if len(template) != len(tokens):
        return 0.0
    pairs = [(a, b) for a, b in zip(template, tokens) if not is_placeholder(a) and not is_placeholder(b)]
    return sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0


class Miner:
    """The state of one scope (or of one token count of it)."""

    def __init__(self, config: MinerConfig = MinerConfig(), known: Iterable[Template] = ()):
        self.config = config
        self.levels = max(1, config.depth - 2)
        self.roots: dict[int, _Node] = {}
        self.templates: dict[int, Template] = {}
        self.ids: dict[int, int] = {}
        self.shapes: dict[int, tuple[int, str]] = {}
        self.lineages: set[int] = set()
        self.next = 1
        self.seen = self.untemplated = self.changes = 0
        for t in known:
            self.next = max(self.next, t.number + 1)
            self._place(t)
            self.lineages.add(t.lineage_id)
            self._note(t)

    def _note(self, t: Template) -> int:
        text = t.text
        h = shape_hash_of(text)
        self.changes += 1
        self.ids[t.number] = h
        self.shapes.setdefault(h, (t.lineage_id, text))  # the first lineage names a hash
        self.templates[t.number] = t
        return h

    def _place(self, t: Template) -> None:
        node = self.roots.setdefault(len(t.tokens), _Node())
        for token in t.tokens[: self.levels]:
            key = WILD if is_placeholder(token) else token
            if key not in node.children and len(node.children) >= self.config.max_children:
                key = WILD
            node = node.children.setdefault(key, _Node())
        place, blocks = len(node.templates), self._blocks(t.tokens)
        node.templates.append(t.number)
        node.places[t.number] = place
        for h in blocks:
            node.blocks.setdefault(h, []).append(place)
        node.literal.append(len(blocks))
        node.by_literal.setdefault(len(blocks), {})[place] = None

    def _leaf(self, tokens: list[str]) -> _Node | None:
        node = self.roots.get(len(tokens))
        if node is None:
            return None
        for token in tokens[: self.levels]:
            key = WILD if is_placeholder(token) else token
            below = node.children.get(key) or node.children.get(WILD)
            if below is None:
                break
            node = below
        return node

    def _cuts(self, n: int) -> tuple[int, int]:
        """Of lines of n tokens: how many tokens may differ, and the number of blocks."""
        spare = min(n, max(0, int(n * (1 - self.config.similarity) + 1e-9)))
        return spare, min(max(0, n - self.levels), 2 * (spare + 1))

    def _blocks(self, tokens: list[str]) -> list[int]:
        """Hashes of those blocks that have no placeholder. What leads to the leaf is in none."""
        many, first = self._cuts(len(tokens))[1], min(self.levels, len(tokens))
        ends = [first + (len(tokens) - first) * j // many for j in range(many + 1)] if many else []
        parts = ((j, *tokens[a:b]) for j, (a, b) in enumerate(zip(ends, ends[1:])))
        return [hash(x) for x in parts if not any(map(is_placeholder, x[1:]))]

    def _near(self, node: _Node | None, tokens: list[str]) -> list[int]:
        """In order of insertion, the node's templates that may be similar enough; some
        may not be, but no other is."""
        if node is None or not node.templates:
            return []
        spare, many = self._cuts(len(tokens))
        own, hits = self._blocks(tokens), {}
        for h in own:
            for place in node.blocks.get(h, ()):
                hits[place] = hits.get(place, 0) + 1
        most = many - len(own) + spare  # so many of a template's blocks may fail to be found
        found = {place for place, n in hits.items() if n >= node.literal[place] - most}
        for n, places in node.by_literal.items():
            if n <= most:
                found.update(places)
        return [node.templates[place] for place in sorted(found)]

    def _widened(self, node: _Node, t: Template) -> None:
        """Its former blocks stay: they lead to it for nothing, which does no harm."""
        place, n = node.places[t.number], len(self._blocks(t.tokens))
        if n != node.literal[place]:
            del node.by_literal[node.literal[place]][place]
            node.literal[place] = n
            node.by_literal.setdefault(n, {})[place] = None

    def add(self, tokens: list[str], at_ns: int = 0, times: int = 1, last_ns: int | None = None, full: bool = False) -> tuple[int | None, bool]:
        """The number of the template that the masked line joins, and whether it is new;
        (None, False) for an empty line or beyond the cap, which `full` says is reached."""
        self.seen += times
        if not tokens:
            return None, False
        best, score, leaf = None, self.config.similarity, self._leaf(tokens)
        for number in self._near(leaf, tokens):
            s = similarity(self.templates[number].tokens, tokens)
            if s >= score:  # the last one inserted wins a tie
                best, score = number, s
        if best is not None:
            t = self.templates[best]
            wider = [a if a == b or a == WILD else WILD for a, b in zip(t.tokens, tokens)]
            t.count += times
            t.last_ns = max(t.last_ns, at_ns if last_ns is None else last_ns)
            if wider != t.tokens:
                t.tokens = wider
                self._widened(leaf, t)
                self._note(t)
            return best, False
        if full or self.config.max_templates is not None and len(self.templates) >= self.config.max_templates:
            self.untemplated += times
            return None, False
        text = " ".join(tokens)
        lineage = shape_hash_of(text)
        if lineage in self.lineages:
            lineage = shape_hash_of(f"{text}\x1f{self.next}")
        self.lineages.add(lineage)
        t = Template(self.next, list(tokens), lineage, times, at_ns, at_ns if last_ns is None else last_ns)
        self.next += 1
        self._place(t)
        self._note(t)
        return t.number, True


def params(template: list[str], tokens: list[str], raw: list[str]) -> list[str]:
    """The raw values where the template is a wildcard or the line a placeholder."""
    return [r for t, m, r in zip(template, tokens, raw) if t == WILD or is_placeholder(m)]


_OUT = "template_id long, template string, lineage_id long, is_new boolean"


def _settled(miner: Miner, shapes: Iterable[tuple[list[str], int, int | None, _Node | None]]) -> bool:
    """Whether every repeat joins its first template, from the shapes (tokens, times, the
    template's number, the leaf at its arrival) and the miner after the last of them."""
    if miner.config.similarity > 1:
        return False
    for tokens, times, number, leaf in shapes:
        if times == 1:
            continue
        if number is None or leaf is None or miner._leaf(tokens) is not leaf or number not in leaf.places:
            return False
        later = (k for k in miner._near(leaf, tokens) if leaf.places[k] > leaf.places[number])
        if any(similarity(miner.templates[k].tokens, tokens) == 1 for k in later):
            return False
    return True


def _moment(values: Iterable) -> tuple:
    return tuple((False, 0) if v is None or v != v else (True, v) for v in values)


def _lines(keys: list[str], config: MinerConfig):
    """The replay of every line, for batches in which a group's rows are together and in
    order; `__full` says that the cap is reached by then. Between two changes of a miner
    equal lines have equal results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, miner, seen, at = None, Miner(config), {}, 0
        for batch in batches:
            rows = []
            for *now, key, full in zip(*(batch.column(k).to_pylist() for k in (*keys, "__key", "__full"))):
                if now != group:
                    group, miner, seen, at = now, Miner(config), {}, 0
                row = seen.get((key, full))
                if row is None:
                    number, new = miner.add(key.split("\x1f"), full=full)
                    t = miner.templates.get(number)
                    row = (miner.ids[number], t.text, t.lineage_id, False) if t else (None, None, None, False)
                    if miner.changes != at:
                        seen, at = {}, miner.changes
                    else:
                        seen[key, full] = row
                    row = (*row[:3], new)
                rows.append(row)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
            new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "template_id", "template", "lineage_id", "is_new"])

    return run


def _capped(rows: DataFrame, cuts: DataFrame | None, scope: list[str], at: Column) -> DataFrame:
    """Adds `__full`: the scope's cap was reached before the row came. Cuts are a row for
    each scope that has more templates than the cap."""
    if cuts is None:
        return rows.withColumn("__full", F.lit(False))
    same = F.lit(True)
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    out = rows.join(cuts, same, "left") if scope else rows.crossJoin(cuts)  # without a scope there is one cut
    return out.withColumn("__full", F.coalesce(at >= F.col("__cut"), F.lit(False))).drop("__cut", *(f"__s{i}" for i in range(len(scope))))


def untemplated(mined: DataFrame, body: str = "body") -> DataFrame:
    """One row: how many records with text have no template, for want of room under the cap."""
    return mined.where(F.col("template_id").isNull() & (F.trim(body) != "")).agg(F.count("*").alias("n"))


def mine_templates(logs: DataFrame, scope: list[str], order: list[str], body: str = "body", config: MinerConfig = MinerConfig(), exact: bool = True) -> DataFrame:
    """Adds template_id and template (as after this line), lineage_id, is_new and params
    to each record. `order` are the columns of arrival, `scope` those that part miners.
    Lines without tokens have nulls. Columns of these names that come in are replaced."""
    ship(logs.sparkSession)
    logs = logs.drop("template_id", "template", "lineage_id", "is_new", "params")
    keys, capped = [*scope, "__n"], config.max_templates is not None
    roomy = replace(config, max_templates=config.max_templates + 1) if capped else config

    def prepared(rows: DataFrame, raw: str | None = None) -> DataFrame:
        return mask_key(rows, body, "__key", raw).withColumn("__n", F.size(split_key(F.col("__key")))).withColumn("__at", F.struct(*order))

    masked = prepared(logs, "__raw")
    since, last, until = ([f"__{x}{i}" for i in range(len(order))] for x in "olu")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(since, kind="stable", na_position="first").reset_index(drop=True)
        miner, shapes, states, rows = Miner(roomy), [], {}, []
        for i, (key, times, full) in enumerate(zip(pdf["__key"], pdf["__times"], pdf["__full"])):
            tokens = key.split("\x1f")
            number, new = miner.add(tokens, 0, int(times), full=bool(full))
            t = miner.templates.get(number)
            of = states.setdefault(number, [])
            if t and (not of or of[-1][1] != miner.ids[number]):
                of.append((i, miner.ids[number], t.text))
            shapes.append((tokens, int(times), number, miner._leaf(tokens)))
            rows.append((i, None, i, *(of[-1][1:] if t else (None, None)), t.lineage_id if t else None, new, len(of) - 1, number))
        opened = exact and not _settled(miner, shapes)
        if opened:
            rows = [(i, None, i, None, None, None, r[6]) for i, r in enumerate(rows)]
        elif exact:  # a row for each state of its template that a shape lives to see
            first, end = ([_moment(v) for v in zip(*(pdf[c] for c in names))] for names in (since, last))
            told = []
            for i, _, _, h, text, lineage, new, k, number in rows:
                begin = i
                for then, h2, text2 in states[number][k + 1 :] if number else ():
                    if first[then] > end[i]:
                        break
                    told.append((begin, then, i, h, text, lineage, new))
                    begin, h, text, new = then, h2, text2, False
                told.append((begin, None, i, h, text, lineage, new))
            rows = told
        out = pdf[[*keys, "__key"]].iloc[[r[2] for r in rows]].reset_index(drop=True)
        for o, u in zip(since, until):
            out[o] = pdf[o].iloc[[r[0] for r in rows]].reset_index(drop=True)
            out[u] = pdf[o].iloc[[r[0] if r[1] is None else r[1] for r in rows]].reset_index(drop=True)
        out["__ends"], out["__open"] = [r[1] is not None for r in rows], opened
        for i, name, kind in ((3, "template_id", "Int64"), (4, "template", object), (5, "lineage_id", "Int64"), (6, "is_new", bool)):
            out[name] = pd.Series([r[i] for r in rows], dtype=kind)
        return out

    types = dict(logs.dtypes)
    first_last = [*((f"__first.{o}", n) for o, n in zip(order, since)), *((f"__last.{o}", n) for o, n in zip(order, last))]
    shapes = prepared(logs.select(*dict.fromkeys([*scope, *order, body]))).where("__n > 0").groupBy(*keys, "__key").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count("*").alias("__times"))
    shapes = shapes.select(*keys, "__key", "__times", *(F.col(c).alias(n) for c, n in first_last))
    schema = ", ".join([*(f"`{s}` {types[s]}" for s in scope), "__n int, __key string", *(f"{n} {types[o]}, {u} {types[o]}" for o, n, u in zip(order, since, until)), f"__ends boolean, __open boolean, {_OUT}"])
    struct = lambda names: F.struct(*(F.col(f).alias(o) for o, f in zip(order, names)))

    def named_by(cuts: DataFrame | None) -> DataFrame:
        """The states of each shape's template; a written table, whose size is known: while
        it is small, it goes to the lines."""
        found = _capped(shapes, cuts, scope, struct(since)).groupBy(*keys).applyInPandas(label, schema)
        found = found.select(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(scope)), F.col("__key").alias("__k"), struct(since).alias("__since"), struct(until).alias("__until"), "__ends", "__open", "template_id", "template", "lineage_id", "is_new", F.xxhash64("__key").alias("__h"))
        return kept(found, "mined-shapes")

    # the cap holds for a scope's templates of all token counts together: from the moment on at
    # which one more would be made (in groups that lines replay: by their shapes), none is
    named, cuts = named_by(None), None
    if capped:
        born = Window.partitionBy(*(f"__s{i}" for i in range(len(scope)))).orderBy("__since")
        births = named.where("is_new").withColumn("__rank", F.row_number().over(born))
        over = births.where(F.col("__rank") == config.max_templates + 1).select(*(f"__s{i}" for i in range(len(scope))), F.col("__since").alias("__cut"))
        if over.limit(1).count():
            cuts = kept(over, "mined-cuts")
            named = named_by(cuts)
    masked = _capped(masked, cuts, scope, F.col("__at"))
    masked = masked.withColumn("__hash", F.xxhash64("__key"))
    on = (F.col("__hash") == F.col("__h")) & (F.col("__key") == F.col("__k"))
    for i, s in enumerate(scope):
        on = on & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    if exact:
        on = on & (F.col("__open") | (F.col("__at") >= F.col("__since")) & (~F.col("__ends") | (F.col("__at") < F.col("__until"))))
    out = masked.join(named, on, "left").withColumn("is_new", F.coalesce(F.col("is_new") & (F.col("__at") == F.col("__since")), F.lit(False)))
    out = out.drop("__k", "__h", "__hash", "__since", "__until", "__ends", *(f"__s{i}" for i in range(len(scope))))
    if exact and named.where("__open").limit(1).count():
        rows = out.where("__open").drop("__open", "__at", "template_id", "template", "lineage_id", "is_new")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + _OUT
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_lines(keys, roomy), schema)
        out = out.where("__open is null or not __open").drop("__open", "__at").unionByName(rows)
    wild = F.split("template", " ")
    slots = F.arrays_zip(wild.alias("t"), split_key(F.col("__key")).alias("m"), F.when(F.col("__key") != "", F.split("__raw", MARK)).otherwise(F.array().cast("array<string>")).alias("r"))
    slots = F.filter(slots, lambda x: (x["t"] == WILD) | (x["m"].contains("<") & x["m"].contains(">")))
    return out.select(*logs.columns, "template_id", "template", "lineage_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.transform(slots, lambda x: x["r"]).alias("params"))


def mine_missing(logs: DataFrame, scope: list[str], order: list[str], **how) -> DataFrame:
    """mine_templates() for the records without a template_id; the others keep theirs."""
    mined = mine_templates(logs.where("template_id is null"), scope, order, **how)
    return mined.unionByName(logs.where("template_id is not null"), allowMissingColumns=True)
