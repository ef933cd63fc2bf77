"""N-gram Jaccard join: documents whose sets of word n-grams are alike, by a prefix-tree join.

1. Equal sets collapse. Of each set the part of least hashes is posted (``posted_size``).
2. Two sets that link share at least ``least_shared`` posted n-grams. Posted n-grams are counted over all sets; a set
   that shares too few goes. The rest order their posted n-grams globally, rare ones first, and keep a prefix such
   that linked sets share an n-gram of both prefixes. The home of a set is the one of its prefix n-grams that most sets
   have, for sets of about its size. A set asks its own home and the greater homes of sets it shares a prefix n-gram with,
   so sets that chance n-grams join in long chains do not meet all the others of the chain.
3. The sets of a home are put into a trie in one order and each that asks is looked up in it: n-grams that several sets begin
   with are compared once, and a subtree is left as soon as what remains of either side cannot reach the overlap required.
   A large home is dealt out in blocks of bounded size, and so are those that ask it.
4. Links join sets to components, by star contractions.

Nothing is sampled or capped; hashes have 64 bits and stand for n-grams, for sets and, beside the id, for texts.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; fewer words than
``n`` make one n-gram of all; repeated rows are linked with each other like other copies; ids may be null or stand for
several texts, as id and text together name a document; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.components import components
from civicspark.llm.tables import discard, in_files, spare_name, written
from civicspark.llm.words import chunks, find_words, shingles

#: N-grams that one task holds of a home, and of the sets that ask it; homes with more are split into blocks.
BLOCK_TOKENS = 1 << 17
#: N-grams of the trie that are looked at together, and marks (queries times different n-grams) of queries that are looked up together.
STEP_LABELS, STEP_MARKS = 1 << 19, 1 << 24


def posted_size(n: Column, percent: int) -> Column:
    """With threshold T, (1 - T) / 0.6 of the set."""
    return F.greatest(F.lit(1), F.ceil(n * (100 - percent) / 60)).cast("int")


def least_shared(n: Column, percent: int) -> Column:
    """N-grams that both sets of a link have among their posted ones, at least.

    Let o be the overlap, f the posted share. The k-th shared n-gram by hash stands at most at place k + (|x| - o) in x, so
    the first o - (1 - f)|x| are posted by x, and o - (1 - f)|y| by y. As o is at least T times either size, both are at
    least (T + f - 1)|x|, which is 2 (1 - T) / 3 of |x| for f = (1 - T) / 0.6.
    """
    return F.greatest(F.lit(1), F.ceil(n * (2 * (100 - percent)) / 300)).cast("int")


def _sets(column: pa.Array, n: int):
    """Sorted distinct n-gram hashes of every text."""
    for _, _, data, offsets in chunks(column):
        words = find_words(data, offsets)
        made, begin = shingles(words.hashes(), words.first, n)
        for k in range(len(offsets) - 1):
            yield np.unique(made[begin[k] : begin[k + 1]])


def _set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _named(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc``, ``said`` (hash of the text) and ``text``."""
    said = F.col(text).cast("string")
    return documents.select(F.col(doc_id).alias("doc"), F.xxhash64(said).alias("said"), said.alias("text"))


def _first_document() -> Column:
    """Of a group the document of least id, null last; of several texts under it that of least hash."""
    return F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "said"))


def _with_sets(documents: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """``doc``, ``said``, size of the set, its id, and its posted n-grams."""

    def made(batches):
        for batch in batches:
            sizes, ids, posted, lengths = [], [], [np.zeros(0, dtype=np.uint64)], []
            for tokens in _sets(batch.column(2), n):
                k = min(len(tokens), max(1, -(-len(tokens) * (100 - percent) // 60)))
                sizes.append(len(tokens))
                ids.append(_set_id(tokens))
                posted.append(tokens[:k])
                lengths.append(k)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()), pa.array(ids, type=pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(posted).view(np.int64)))],
                names=["doc", "said", "n", "set", "posted"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    return _named(documents, doc_id, text).mapInArrow(made, f"doc {kind}, said long, n long, set long, posted array<long>")


class Trie:
    """Sets as paths over one order of their n-grams; chains without branches are one node."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: ascending distinct integers, no two sets equal."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        parent, begin, end, of, least, most, leaf = [-1], [0], [0], [order[0]], [0], [0], [-1]
        path, before = [0], None
        for k in order:
            own = sets[k]
            shared = 0
            if before is not None:
                both = min(len(own), len(before))
                differ = np.flatnonzero(own[:both] != before[:both])
                shared = int(differ[0]) if len(differ) else both
            last = -1
            while end[path[-1]] > shared:
                last = path.pop()
            if end[path[-1]] < shared:  # the branch point lies inside a chain: cut it there
                node = len(parent)
                parent.append(path[-1]), begin.append(end[path[-1]]), end.append(shared), of.append(of[last]), leaf.append(-1)
                parent[last], begin[last] = node, shared
                path.append(node)
            node = len(parent)
            parent.append(path[-1]), begin.append(end[path[-1]]), end.append(len(own)), of.append(k), leaf.append(k)
            path.append(node)
            before = own
        self.size = np.array([len(s) for s in sets])
        self.parent, self.begin, self.end, self.leaf = map(np.array, (parent, begin, end, leaf))
        count = len(parent)
        least, most = np.full(count, np.iinfo(np.int64).max), np.zeros(count, dtype=np.int64)
        at = np.flatnonzero(self.leaf >= 0)
        least[at] = most[at] = self.size[self.leaf[at]]
        level = np.zeros(count, dtype=np.int64)
        node_order = sorted(range(count), key=lambda v: end[v], reverse=True)
        for v in node_order:
            if parent[v] >= 0:
                least[parent[v]] = min(least[parent[v]], least[v])
                most[parent[v]] = max(most[parent[v]], most[v])
        for v in reversed(node_order):
            level[v] = level[parent[v]] + 1 if parent[v] >= 0 else 0
        self.least, self.most = least, most
        self.labels = np.concatenate([sets[of[v]][begin[v] : end[v]] for v in range(count)]).astype(np.int64)
        self.width = self.end - self.begin
        self.at = np.cumsum(self.width) - self.width
        self.last = np.array([sets[of[v]][end[v] - 1] if end[v] else -1 for v in range(count)])
        children = np.argsort(self.parent[1:], kind="stable") + 1
        self.children = children
        self.first_child = np.searchsorted(self.parent[children], np.arange(count + 1))
        #: More than the greatest integer of any set or query.
        self.names = int(max((s[-1] for s in sets if len(s)), default=0)) + 1

    def alike(self, queries: list[np.ndarray], percent: int) -> list[np.ndarray]:
        """For each of ``queries`` the sets whose Jaccard similarity with it is at least ``percent`` / 100; all go down the trie together.

        A query holds integers below ``names``.
        """
        names = self.names
        sizes = np.array([len(q) for q in queries])
        # Those of query q come after those of the queries before it.
        asked = np.concatenate([q + at * names for at, q in enumerate(queries)])
        begin = np.cumsum(sizes) - sizes
        mark = np.zeros(len(queries) * names, dtype=np.uint8)
        mark[asked] = 1
        who, nodes, overlap = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        found_by, found = [], []
        while len(nodes):
            n = self.first_child[nodes + 1] - self.first_child[nodes]
            start = np.cumsum(n) - n
            children = self.children[np.arange(n.sum()) - np.repeat(start, n) + np.repeat(self.first_child[nodes], n)]
            if not len(children):
                break
            who, own, width = np.repeat(who, n), np.repeat(overlap, n), self.width[children]
            total = np.cumsum(width)
            low = 0
            while low < len(children):
                done = total[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(total, done + STEP_LABELS, side="right")))
                wide = width[low:high]
                into = total[low:high] - wide - done
                place = np.arange(wide.sum()) + np.repeat(self.at[children[low:high]] - into, wide)
                own[low:high] += np.add.reduceat(mark[self.labels[place] + np.repeat(who[low:high] * names, wide)], into, dtype=np.int64)
                low = high
            rest = sizes[who] + begin[who] - np.searchsorted(asked, self.last[children] + who * names, side="right")
            reach = own + np.minimum(rest, self.most[children] - self.end[children])
            keep = reach * (100 + percent) >= percent * (sizes[who] + self.least[children])
            who, nodes, overlap = who[keep], children[keep], own[keep]
            ends = np.flatnonzero(self.leaf[nodes] >= 0)
            sets = self.leaf[nodes[ends]]
            alike = overlap[ends] * (100 + percent) >= percent * (sizes[who[ends]] + self.size[sets])
            found_by.append(who[ends][alike]), found.append(sets[alike])
        who, found = np.concatenate([np.zeros(0, dtype=np.int64), *found_by]), np.concatenate([np.zeros(0, dtype=np.int64), *found])
        order = np.argsort(who, kind="stable")
        return np.split(found[order], np.searchsorted(who[order], np.arange(1, len(queries))))


def links_between(sets: list[np.ndarray], asked: np.ndarray, stored: np.ndarray, percent: int):
    """For each set of ``asked`` the sets of ``stored`` (places in ``sets``) that it links with, itself left out."""
    flat = np.concatenate(sets)
    _, local, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(s) for s in np.split(rank[local], cuts)]
    trie = Trie([ranked[k] for k in stored])
    trie.names = len(count)
    together = max(1, STEP_MARKS // max(1, len(count)))
    for low in range(0, len(asked), together):
        some = asked[low : low + together]
        for k, near in zip(some, trie.alike([ranked[k] for k in some], percent), strict=True):
            found = stored[near]
            yield k, found[found != k]


def _find_links(percent: int):
    def found(group: pd.DataFrame) -> pd.DataFrame:
        a, b, links = [], [], []
        for (*_, piece), part in group.groupby(["weight", "home", "level", "block", "piece"], sort=False):
            part = part.drop_duplicates("set")
            own = part["own"].to_numpy(dtype=bool)
            ids, copies = part["set"].to_numpy(), part["copies"].to_numpy()
            sets = [np.asarray(t) for t in part["tokens"]]
            stored, asking = np.flatnonzero(own), np.flatnonzero(~own)
            if not len(stored) or len(sets) < 2:
                continue
            tree = np.arange(len(ids))  # of each place: only links that join two trees are sent on
            linked = np.zeros(len(ids), dtype=np.int64)
            # The sets of a block meet each other in its first piece only.
            for k, near in links_between(sets, np.concatenate([asking, stored]) if piece == 0 else asking, stored, percent):
                if not len(near):
                    continue
                linked[k] += copies[near].sum()
                if not own[k]:
                    linked[near] += copies[k]
                for other in near[np.unique(tree[near], return_index=True)[1]]:
                    if tree[other] != tree[k]:
                        tree[tree == tree[other]] = tree[k]
                        a.append(ids[k]), b.append(ids[other]), links.append(0)
            some = np.flatnonzero(linked)
            a.extend(ids[some]), b.extend(ids[some]), links.extend(linked[some])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64), "links": np.array(links, dtype=np.int64)})

    return found


#: A home: how many sets have its n-gram, the n-gram, and how large its sets are.
HOME = ["weight", "home", "level"]


def _level(n: Column, percent: int) -> Column:
    """Sets that link are on one level or on two next to each other, as one has at least ``percent`` of the other's size."""
    step = max(math.log(100 / percent), 1e-3) * 1.0001  # a little more, so that rounding does no harm
    return F.floor(F.log(n.cast("double")) / F.lit(step)).cast("int")


def _homes(prefixes: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``set``, ``n`` and home of every set that shares an n-gram of ``prefixes``; ``set``, ``n`` and the other homes that it asks.

    Of two sets that share a prefix n-gram and are on levels next to each other, one asks the home of the other or both have one home.
    ``prefixes`` is a written table of ``most`` rows.
    """
    counts = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    counts = written(in_files(counts, most), "prefix-counts")
    shared = prefixes.join(counts, "token")
    homes = shared.groupBy("set").agg(F.first("n").alias("n"), F.max(F.struct("k", "token")).alias("top")).select(
        "set", "n", F.col("top.k").alias("weight"), F.col("top.token").alias("home"), _level(F.col("n"), percent).alias("level")
    )
    homes = written(in_files(homes, most), "homes")
    listed = written(in_files(shared.select("set", "token").join(homes, "set"), most), "listed")
    held = listed.select("token", *HOME).distinct().select("token", F.struct(*HOME).alias("there"))
    asks = listed.join(held, "token").filter(
        (F.col("there") > F.struct(*HOME)) & (F.abs(F.col("there.level") - F.col("level")) <= 1)
    ).select("set", "n", "there.*").distinct()
    asks = written(in_files(asks, most), "asks")
    discard(counts, listed)
    return homes, asks


def _places(homes: DataFrame, asks: DataFrame, most: int) -> DataFrame:
    """Where each set goes: ``set``, its home or one that it asks, ``block`` and ``piece``, ``own`` and ``pack``.

    The sets of a home lie in blocks (``own``), each once for every piece of the sets that ask; a set that asks is in one piece of every
    block. A set of a home of several blocks asks those before its own. A pack is the work of one task: pieces of large homes, or
    small homes together.
    """
    sizes = homes.select(*HOME, "n", F.lit(0).alias("asking")).unionByName(asks.select(*HOME, F.lit(0).alias("n"), F.col("n").alias("asking")))
    blocks = F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int")
    sizes = sizes.groupBy(*HOME).agg(
        F.count(F.lit(1)).alias("sets"), blocks.alias("blocks"),
        F.greatest(F.lit(1), F.ceil((F.sum("asking") + F.when(blocks > 1, F.sum("n")).otherwise(0)) / BLOCK_TOKENS)).cast("int").alias("pieces"),
        (F.sum("n") + F.sum("asking")).alias("tokens"),
    ).filter("sets > 1").drop("sets")
    sizes = written(in_files(sizes, most), "home-sizes")
    packs = int((sizes.filter("blocks = 1 and pieces = 1").agg(F.sum("tokens")).first()[0] or 0) // BLOCK_TOKENS) * 2 + 1
    held = sizes.drop("tokens")

    def dealt(column: str) -> Column:
        return F.pmod(F.xxhash64("set"), F.col(column)).cast("int")

    def up_to(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    kept = ["set", *HOME, "block", "piece", "blocks", "pieces"]
    at_home = homes.join(held, HOME).withColumn("block", dealt("blocks"))
    own = at_home.withColumn("piece", up_to("pieces")).select(*kept, F.lit(True).alias("own"))
    before = at_home.filter("block > 0").withColumn("block", up_to("block")).withColumn("piece", dealt("pieces")).select(*kept, F.lit(False).alias("own"))
    others = asks.join(held, HOME).withColumn("block", up_to("blocks")).withColumn("piece", dealt("pieces")).select(*kept, F.lit(False).alias("own"))
    alone = (F.col("blocks") > 1) | (F.col("pieces") > 1)
    pack = F.when(alone, F.xxhash64(*HOME, "block", "piece")).otherwise(F.pmod(F.xxhash64(*HOME), F.lit(packs)))
    places = own.unionByName(before).unionByName(others).select("set", *HOME, "block", "piece", "own", pack.alias("pack"))
    places = written(in_files(places, most), "places")
    discard(sizes)
    return places


def join_alike(documents: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least document reachable by links) and ``n_links`` of every row.

    Documents link when ``100 * shared >= percent * united`` n-grams of ``n`` words; ``percent`` from 41 to 100.
    """
    sets, known = _components(documents, n, percent, doc_id, text)
    full = F.col("n") > 0
    return (
        sets.select("doc", "n", F.when(full, F.col("set")).alias("set")).join(known, "set", "left")
        .select(
            F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"),
            F.when(full, F.col("component.doc")).otherwise(F.col("doc")).alias("component_id"),
            F.coalesce("links", F.lit(0)).alias("n_links"),
        )
    )


def _components(documents: DataFrame, n: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc``, ``said``, ``n`` and ``set`` of every row; of every set not empty its ``component`` (first document) and ``links``."""
    if not 40 < percent <= 100:
        raise ValueError("percent must be over 40 and at most 100")
    sets = written(_with_sets(documents, doc_id, text, n, percent), "sets")
    size = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum(posted_size(F.col("n"), percent).cast("long")).alias("posted")).first()
    rows, posted = size.rows, size.posted or 0
    distinct = sets.filter("n > 0").groupBy("set").agg(
        _first_document().alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("posted").alias("posted")
    )
    posts = distinct.select("set", "n", F.explode("posted").alias("token"))
    shared = written(in_files(posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), posted), "shared-grams")
    needed, held = least_shared(F.col("n"), percent), F.size("grams")
    prefixes = posts.join(shared, "token").groupBy("set").agg(
        F.first("n").alias("n"), F.collect_list(F.struct("df", "token")).alias("grams")
    ).filter(held >= needed).select("set", "n", F.explode(F.slice(F.sort_array("grams"), F.lit(1), held - needed + 1)["token"]).alias("token"))
    prefixes = written(in_files(prefixes, posted), "prefixes")
    most = prefixes.count()
    homes, asks = _homes(prefixes, percent, most)
    discard(shared, prefixes)
    places = _places(homes, asks, most)

    members = written(in_files(distinct.drop("posted", "n").join(places.select("set").distinct(), "set"), rows), "members")
    # By id and text: rows without an id, or texts under one id, would each meet the sets of all the others.
    named = _named(documents, doc_id, text)
    chosen = named.join(
        members,
        (F.col("said") == F.col("first.said")) & F.col("doc").eqNullSafe(F.col("first.doc")),
    )
    full = chosen.select("text", "set", "copies").mapInArrow(_full_sets(n), "set long, copies long, tokens array<long>")
    compared = places.join(full, "set").groupBy("pack").applyInPandas(_find_links(percent), "a long, b long, links long")
    found = written(compared, "links")
    discard(homes, asks, places, members)
    joined = components(found.filter("a <> b"), most=found.count())
    degrees = found.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))

    by_set = (
        sets.filter("n > 0").groupBy("set").agg(F.count(F.lit(1)).alias("copies"), _first_document().alias("first"))
        .join(degrees, "set", "left").join(joined.withColumnRenamed("node", "set"), "set", "left")
        .select("set", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root"))
    )
    by_set = written(in_files(by_set, rows), "by-set")
    firsts = written(in_files(by_set.groupBy("root").agg(F.min("first").alias("component")), rows), "component-first")
    known = by_set.join(firsts, "root").select("set", "component", (F.col("copies") - 1 + F.col("links")).alias("links"))
    known = written(in_files(known, rows), "components")
    discard(found, by_set, firsts)
    return sets, known


def _full_sets(n: int):
    def made(batches):
        seen: set[int] = set()  # repeated rows of one document
        for batch in batches:
            place = {name: batch.column(name).to_numpy() for name in ("set", "copies")}
            kept, tokens = [], []
            for k, own in enumerate(_sets(batch.column(0), n)):
                own_id = _set_id(own)
                if own_id == place["set"][k] and own_id not in seen:  # texts of one hash are told apart
                    seen.add(own_id)
                    kept.append(k)
                    tokens.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(place[c][kept]) for c in ("set", "copies")], pa.array(tokens, type=pa.list_(pa.int64()))],
                names=["set", "copies", "tokens"],
            )

    return made


def keep_first(documents: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of least id (null last), with all its columns.

    Id and text name a document: of rows that repeat both, one stays; different texts under one id, or under none, are
    documents of their own.
    """
    sets, known = _components(documents, n, percent, doc_id, text)
    doc, said = spare_name(documents, "doc"), spare_name(documents, "said")
    kept = (
        known.select("component.doc", "component.said").union(sets.filter("n = 0").select("doc", "said")).distinct()
        .select(F.col("doc").alias(doc), F.col("said").alias(said))
    )
    kept = written(in_files(kept, sets.count()), "kept")
    own = spare_name(documents, "own")
    return (
        documents.withColumn(own, F.xxhash64(F.col(text).cast("string")))
        .join(kept, (F.col(own) == F.col(said)) & F.col(doc_id).eqNullSafe(F.col(doc)))
        .dropDuplicates([doc_id, own]).drop(own, doc, said)
    )
