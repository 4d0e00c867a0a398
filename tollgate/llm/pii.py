"""Personal data: base patterns, and terms that disclose a protected value.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; each
distinct value is a *protected entity*.  A word can give an entity away even where the value
itself is missing.  How strongly it does is estimated from the corpus: with N documents,
n_e that hold entity e, n_t that hold term t, and n_te that hold both, wherever they stand,

    PMI(t; e) = log2(N * n_te / (n_t * n_e)),   IC(e) = log2(N / n_e)

and t discloses the share PMI / IC of what there is to know about e.  Terms at or beyond
``DISCLOSES`` are sanitised wherever they stand: generalised to their word class up to
``REMOVES``, removed beyond.  A pair needs ``SUPPORT`` documents with different words, so that
copies of one text prove nothing (copies that were edited count as different).

1. One scan finds base spans and the distinct words of texts that have any (a written table).
2. One scan counts n_t within batches, then by term.
3. Entities in too few different documents are settled by their counts.  Pairs of all others are
   counted within batches; a frequent term that could not disclose an entity even if it stood in
   all its documents (n_t is known) makes no pair.
4. One scan finds the disclosing terms in all documents.  Tasks hold up to ``BLOCK`` of them;
   more are sieved by a bitmap of bounded size, and what it lets through is joined with them.

Counts are aggregated by (entity, term), within batches before they are shuffled; nothing else
about an entity is gathered, however frequent it is.

Edge cases: a null text is empty; rows that share doc_id and text get the same result each; a
null doc_id is kept; equal values of a document count once; an empty table gives an empty one;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import bound_batches, column, fresh, map_batches, row_key, texts, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3             # documents with different words that a pair needs
DISCLOSES = 0.8         # share of an entity's information from which a term is sanitised
REMOVES = 0.95          # share from which it is removed
BLOCK = 1 << 19         # disclosing terms that a task holds
COMMON = 1 << 16        # most frequent terms whose counts a task holds
PAIRS = 1 << 18         # pairs that a task counts before it passes them on
SIEVE = 1 << 26         # bits of the bitmap for more than BLOCK terms

# The same matches as the published patterns, found in linear time: what stands before an "@"
# is read backwards, and a number starts only where a run of digits starts.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        a = at = m.start()
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at:
            out.append((a, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind, then start; leftmost matches that don't overlap, failing ones dropped."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def show(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct values of a text, with their kind."""
    return list(dict.fromkeys(f"{k}:{text[a:b].lower() if k in ('email', 'ip') else _DIGITS.sub('', text[a:b])}" for k, a, b in spans))


def terms_beside(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct words of a text outside its values, numbers left out, sorted."""
    covered = sorted((a, b) for _, a, b in spans)
    found, k, end = set(), 0, 0
    for m in _WORD.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            end = max(end, covered[k][1])
            k += 1
        if m.start() >= end and not m[0].isdigit():
            found.add(m[0].lower())
    return sorted(found)


def words_hash(terms: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(terms), 0) >> 1


def surroundings(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, list[str]]]:
    """(entity, hash of its surroundings, terms with it) for each distinct value of a text."""
    terms = terms_beside(text, spans)
    return [(e, words_hash(terms), terms) for e in entities(text, spans)]


def find_base(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, base, entities, around, words."""

    def run(batch: pa.RecordBatch):
        counts, sha, shown, held, around, beside = [[] for _ in KINDS], [], [], [], [], []
        for t in texts(batch):
            spans = base_spans(t)
            s = show(spans)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(x[0] == kind for x in spans))
            sha.append(hashlib.sha256(s.encode()).hexdigest())
            shown.append(s)
            held.append(entities(t, spans))
            beside.append(terms_beside(t, spans) if spans else [])
            around.append(words_hash(beside[-1]))
        many = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), column(batch, "key"), *(pa.array(c, pa.int64()) for c in counts),
             pa.array(sha), pa.array(shown), pa.array(held, many), pa.array(around, pa.int64()), pa.array(beside, many)],
            names=["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "entities", "around", "words"],
        )

    return map_batches(
        docs.select("doc_id", row_key().alias("key"), "text"), run,
        "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
        "entities array<string>, around long, words array<string>",
    )


def documents_with(docs: DataFrame) -> DataFrame:
    """term, n_t: how many rows hold each term, counted within batches before any shuffle."""

    def run(batch: pa.RecordBatch):
        count: Counter = Counter()
        for t in texts(batch):
            count.update({w.lower() for w in set(_WORD.findall(t)) if not w.isdigit()})
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    return map_batches(docs.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def pair_counts(held: DataFrame, common: dict[str, int], support: int) -> DataFrame:
    """entity, term, around, n from rows of (entity, most, around, terms), counted within batches.

    Of a pair's different surroundings a batch names ``support`` at most, which tells whether there
    are as many in all; the rows of a pair add up to its documents.  Terms that stand in more than
    ``most`` documents cannot disclose the entity.
    """

    def run(batch: pa.RecordBatch):
        count: dict[tuple[str, str], list] = {}
        rows = zip(*(column(batch, c).to_pylist() for c in ("entity", "most", "around", "terms")))
        for entity, most, around, terms in rows:
            for t in terms:
                if common.get(t, 0) <= most:
                    x = count.get((entity, t))
                    if x is None:
                        count[entity, t] = [1, around]
                    else:
                        x[0] += 1
                        if len(x) <= support and around not in x[1:]:
                            x.append(around)
            if len(count) >= PAIRS:
                yield from show_counts(count)
                count = {}
        yield from show_counts(count)

    def show_counts(count):
        rows = [(e, t, h, 0 if k else x[0]) for (e, t), x in count.items() for k, h in enumerate(x[1:])]
        if rows:
            e, t, h, n = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(e, pa.string()), pa.array(t, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["entity", "term", "around", "n"]
            )

    return map_batches(held.select("entity", "most", "around", "terms"), run, "entity string, term string, around long, n long")


def find_terms(docs: DataFrame, action: Callable[[str], str | None]) -> DataFrame:
    """doc_id, key and the spans of terms that have an action, for rows with any."""

    def run(batch: pa.RecordBatch):
        rows = []
        for k, t in enumerate(texts(batch)):
            hit = {w: x for w in set(_WORD.findall(t)) if (x := action(w.lower()))}
            if hit:
                rows.append((k, [{"term": m[0].lower(), "a": m.start(), "b": m.end(), "action": hit[m[0]]} for m in _WORD.finditer(t) if m[0] in hit]))
        at = pa.array([k for k, _ in rows], pa.int64())
        kind = pa.list_(pa.struct([("term", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("action", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()).take(at), column(batch, "key").take(at), pa.array([s for _, s in rows], kind)],
            names=["doc_id", "key", "found"],
        )

    return map_batches(
        docs.select("doc_id", row_key().alias("key"), "text"), run,
        "doc_id long, key long, found array<struct<term:string,a:long,b:long,action:string>>",
    )


def _share(n: int, holds: str) -> Column:
    """PMI / IC of a pair with n_te and n_e, ``holds`` being the documents that hold the term."""
    pmi = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col(holds) * F.col("n_e")))
    return pmi / F.log2(F.lit(float(n)) / F.col("n_e"))


def disclosing(docs: DataFrame, base: DataFrame, discloses: float = DISCLOSES, support: int = SUPPORT) -> DataFrame | None:
    """term, share, action of the terms that disclose a value; None if there are none."""
    n = base.count()
    near = base.where(F.size("entities") > 0)
    n_e = near.select(F.explode("entities").alias("entity"), "around").groupBy("entity", "around").agg(F.count("*").alias("n"))
    n_e = n_e.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("ways"))
    # a term in more documents than ``most`` stays below the threshold even if it is in all n_e;
    # the margin is for rounding, the share itself decides
    most = F.lit(float(n)) * F.pow(F.col("n_e") / F.lit(float(n)), F.lit(discloses)) * F.lit(1 + 1e-9)
    n_e = written(n_e.where((F.col("ways") >= support) & (F.col("n_e") < n)).select("entity", "n_e", most.alias("most")), "entities")
    if n_e.isEmpty():
        return None
    n_t = written(documents_with(docs).where(F.col("n_t") >= support), "words")
    common = {r.term: r.n_t for r in n_t.orderBy(F.desc("n_t"), "term").limit(COMMON).collect()}  # bounded by COMMON
    held = near.select(F.explode("entities").alias("entity"), "around", F.col("words").alias("terms")).join(n_e.select("entity", "most"), "entity")
    pairs = pair_counts(held, common, support).groupBy("entity", "term", "around").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("ways"))
    pairs = pairs.where(F.col("ways") >= support).join(n_e.select("entity", "n_e"), "entity").join(n_t, "term")
    scored = pairs.withColumn("share", _share(n, "n_t")).where(F.col("share") >= discloses)
    flagged = scored.groupBy("term").agg(F.max("share").alias("share"))
    action = F.when(F.col("share") >= REMOVES, F.lit("remove")).otherwise(F.lit("generalise"))
    flagged = written(flagged.withColumn("action", action), "flagged")
    return None if flagged.isEmpty() else flagged


def sieve(flagged: DataFrame) -> Callable[[str], str | None]:
    """Says "?" of every flagged term and of few others, from a bitmap of ``SIEVE`` bits."""
    bit = F.pmod(F.xxhash64("term"), F.lit(SIEVE))
    chunks = flagged.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    wide = 1 << 15  # bits of a bucket; Spark's bucket 1 begins at bit 1, and bit 0 is bucket 0's position 0
    bits = {r.k: bytes(r.bits) for r in chunks.collect()}  # bounded by SIEVE

    def action(word: str) -> str | None:
        h = xxhash.xxh64_intdigest(word.encode(), 42) % SIEVE
        k, at = (1 + (h - 1) // wide, (h - 1) % wide) if h else (0, 0)
        return "?" if k in bits and bits[k][at >> 3] >> (at & 7) & 1 else None

    return action


def term_spans(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, key and the sorted spans (a, b, action) of flagged terms; a row per text."""
    span = "struct<a:long,b:long,action:string>"
    if flagged.count() <= BLOCK:
        action = {r.term: r.action for r in flagged.select("term", "action").collect()}  # bounded by BLOCK
        found = find_terms(docs, action.get).groupBy("doc_id", "key").agg(F.first("found").alias("found"))
        spans = F.transform("found", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["action"].alias("action")))
        return found.select("doc_id", "key", F.array_sort(spans).cast(f"array<{span}>").alias("terms"))
    one = find_terms(docs, sieve(flagged)).select("doc_id", "key", F.explode("found").alias("s"))
    one = one.select("doc_id", "key", F.col("s.term").alias("term"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    one = one.join(flagged.select("term", "action"), "term").select("doc_id", "key", F.struct("a", "b", "action").cast(span).alias("s"))
    return one.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("s")).alias("terms"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, the method's kind is ``term``)."""
    base = written(find_base(docs), "base")
    out = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    flagged = disclosing(docs, base)
    if flagged is None:
        return base.select(*out, F.col("base").alias("spans"))
    spans = written(term_spans(docs, flagged).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "terms"), "spans")
    both = base.join(spans, base["doc_id"].eqNullSafe(spans["_doc"]) & (base["key"] == spans["_key"]), "left")
    shown = F.array_join(F.transform("terms", lambda s: F.concat(F.lit("term:"), s["a"].cast("string"), F.lit(":"), s["b"].cast("string"))), ",")
    shown = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, shown))
    return both.select(*out, shown.alias("spans"))


def word_class(word: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitise_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Base values become their kind, disclosing terms their word class or nothing."""
    out, at = [], 0
    for a, b, what in sorted(spans):
        if a >= at:
            new = word_class(text[a:b]) if what == "generalise" else "" if what == "remove" else f"[{what.upper()}]"
            out += [text[at:a], new]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised, all other columns as they were."""
    base = written(find_base(docs), "base")
    flagged = disclosing(docs, base)
    name = fresh("terms", docs)
    if flagged is not None:
        terms = term_spans(docs, flagged)
    else:
        terms = base.limit(0).select("doc_id", "key").withColumn("terms", F.lit(None).cast("array<struct<a:long,b:long,action:string>>"))
    terms = terms.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("terms").alias(name))
    same = docs["doc_id"].eqNullSafe(terms["_doc"]) & (row_key(docs["text"]) == terms["_key"])
    both = docs.join(terms, same, "left").select(*(docs[c] for c in docs.columns), terms[name])
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        new = []
        for t, extra in zip(column(batch, "text").to_pylist(), column(batch, name).to_pylist()):
            spans = [(a, b, k) for k, a, b in base_spans(t or "")] + [(s["a"], s["b"], s["action"]) for s in extra or []]
            new.append(sanitise_text(t, spans) if spans else t)
        at = batch.schema.get_field_index("text")
        kept = batch.set_column(at, batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
        yield kept.drop_columns([name])

    return map_batches(both, run, docs.schema)
