"""Language identification by Bayesian fusion of evidence (operator 3)."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import BROADCAST_ROWS, short_batches, small, sub_batches, written

#: Languages whose likelihoods are held, sent and computed together; there may be any number of such groups.
GROUP = 64
#: Hash buckets of three-byte sequences.
BUCKETS = 1 << 14
#: Neighbouring sequences overlap, so each counts as a part of an observation, in texts of any length.
WEIGHT = 0.25
#: Pseudo-counts: of the language's text model, of a host's parent domain for the host, of the whole for the domain.
ALPHA, HOST_STRENGTH, DOMAIN_STRENGTH, SIGNAL_STRENGTH = 200.0, 20.0, 50.0, 20.0
#: Prior share of texts in none of the languages, and the probability from which a text is accepted.
NONE_PRIOR, ACCEPT = 0.001, 0.5
UNKNOWN = "und"
_LETTERS = set(string.ascii_letters.encode())
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS or b >= 128 else 32 for b in range(256))
_CHUNK = 1 << 20
#: Bytes of short texts that are counted together; their sequences take about 16 times as much for a moment.
_SHORT = 1 << 18


def sequences(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the three-byte sequences of a text, without what is no letter; in stretches of long texts."""
    if not text:
        return
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    for at in range(0, len(x) - 2, _CHUNK):
        y = x[at : at + _CHUNK + 2].astype(np.uint32)
        if len(y) > 2:
            yield (((y[:-2] * np.uint32(0x9E3779B1)) ^ (y[1:-1] * np.uint32(0x85EBCA77)) ^ (y[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)) >> np.uint32(18)


def log_likelihood(text: str | None, model: list[np.ndarray]) -> np.ndarray | None:
    """Log likelihood of a text in each language, group by group, and in none of them (last); null without a letter."""
    total, n = [np.zeros(m.shape[1]) for m in model], 0
    for b in sequences(text):
        counts = np.bincount(b, minlength=BUCKETS) if len(b) >= BUCKETS else None
        for t, m in zip(total, model):
            t += m[b].sum(0, dtype=np.float64) if counts is None else counts @ m
        n += len(b)
    return np.concatenate(total) * WEIGHT if n else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, declared) to declared, bucket, n: sums of at most GROUP languages are held at once."""
    total: dict[str, np.ndarray] = {}
    short: dict[str, list[np.ndarray]] = {}  # stretches that are counted together

    def add() -> None:
        for declared, each in short.items():
            total[declared] += np.bincount(np.concatenate(each), minlength=BUCKETS)
        short.clear()

    def told() -> Iterator[pa.RecordBatch]:
        for declared, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([declared] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], ["declared", "bucket", "n"])

    for b in sub_batches(batches, "text", _SHORT):
        for text, declared in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x in sequences(text):
                if len(total) >= GROUP and declared not in total:
                    add()
                    yield from told()
                    total.clear()
                total.setdefault(declared, np.zeros(BUCKETS, np.int64))
                if len(x) >= BUCKETS:
                    total[declared] += np.bincount(x, minlength=BUCKETS)
                else:
                    short.setdefault(declared, []).append(x)
        add()
    yield from told()


def fit_text_model(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """The languages, and in groups of them log probabilities of every bucket in each and in none, from (text, declared).

    Every declared row counts, with its whole text.  Every language that is declared for a text with letters is fitted; the
    fewer sequences it has, the nearer it is to the shared counts.
    """
    counted = docs.where("declared IS NOT NULL").select("text", "declared").mapInArrow(_counted, "declared string, bucket int, n long")
    found = written(counted.groupBy("declared", "bucket").agg(F.sum("n").alias("n")), "sequences")
    languages = sorted(r[0] for r in found.select("declared").distinct().collect())
    if not languages:
        return [], [np.zeros((BUCKETS, 1), np.float32)]
    counts = np.zeros((BUCKETS, len(languages)), np.float32)
    at = {x: i for i, x in enumerate(languages)}
    for g in range(0, len(languages), GROUP):
        part = found.where(F.col("declared").isin(languages[g : g + GROUP])).toPandas()
        counts[part.bucket.to_numpy(int), part.declared.map(at).to_numpy(int)] = part.n
    size = counts.sum(0, dtype=np.float64)
    sure = size / (size + ALPHA)  # a language says as much about the shared counts as about itself
    share = sum(counts[:, i] / size[i] * sure[i] for i in range(len(languages))) / sure.sum() * 0.9 + 0.1 / BUCKETS
    model = [np.log((counts[:, g : g + GROUP] + ALPHA * share[:, None]) / (size[g : g + GROUP] + ALPHA)).astype(np.float32) for g in range(0, len(languages), GROUP)]
    model[-1] = np.column_stack([model[-1], np.full(BUCKETS, -np.log(BUCKETS), np.float32)])
    return languages, model


def primary(tag: Column) -> Column:
    """The language of a tag such as en-GB; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """The host of an address, the domain it belongs to (its last two labels), and its suffix (the last label)."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return host, F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0), F.nullif(F.regexp_extract(host, r"\.([^.0-9]+)$", 1), F.lit(""))


def identify(docs: DataFrame, *, keep: tuple[str, ...] = (), declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_id, probability, text_lang and accepted of every row of ``docs``, and its columns ``keep``.

    ``declared`` is the language the markup declares, ``host`` the place the text comes from, ``domain`` what the host
    belongs to, ``suffix`` the end of its address; each may be null or missing and then says nothing.

    First each text is given its likelihood in each language, once; these are written, a number for each language and
    row.  The likeliest languages, grouped by host, domain, suffix and declaration, give, with pseudo-counts from the next
    wider level, each host's prior, and how often each declaration and suffix goes with each language.  Then all are
    multiplied with the text likelihood.  Of languages that are equally likely the first by name is taken.  ``accepted`` is false where no known
    language has a probability of ACCEPT, which includes null, empty and letterless texts (lang_id "und").  Repeated rows and null
    ids stay.  Without any declared row all texts are "und".
    """
    short_batches(docs)
    none = F.lit(None).cast("string")
    text = lambda c: none if c is None else c.cast("string")
    base = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.col(text_col).alias("text"), primary(text(declared)).alias("declared"), text(host).alias("host"), text(domain).alias("domain"), text(suffix).alias("suffix"))
    languages, model = fit_text_model(base.select("text", "declared"))
    groups = [docs.sparkSession.sparkContext.broadcast(m) for m in model]
    carried = [c for c in base.columns if c != "text"]

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = [g.value for g in groups]
        for b in sub_batches(batches, "text"):
            like = [None if (x := log_likelihood(t, model)) is None else (x - x.max()).astype(np.float32) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carried), pa.array(like, pa.list_(pa.float32()))], [*carried, "like"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    scored = written(base.mapInArrow(likelihoods, f"{kinds}, like array<float>"), "likelihoods")
    best = (F.array_position("like", F.array_max("like")) - 1).cast("int").alias("best")
    met = scored.where("like IS NOT NULL").select("declared", "host", "domain", "suffix", best).where(F.col("best") < len(languages))
    met = written(met.groupBy("declared", "host", "domain", "suffix", "best").agg(F.count("*").alias("n")), "met")
    k = len(languages)

    def by(*keys: str) -> DataFrame:
        if k <= GROUP:
            sums = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double") for i in range(k)]
            return met.groupBy(*keys).agg(F.array(*sums).alias("n")) if k else met.groupBy(*keys).agg(F.array().cast("array<double>").alias("n"))
        each = met.groupBy(*keys, "best").agg(F.sum("n").cast("double").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))
        return each.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("n"))

    few = lambda df: small(df, BROADCAST_ROWS * GROUP // max(k, GROUP))  # noqa: E731  rows have an array of k
    whole = np.array((by().first() or [None])[0] or [0.0] * k, float)
    spread = (whole + 1) / (whole.sum() + k) if k else whole
    arr = lambda x: F.array(*(F.lit(float(v)) for v in x)) if k else F.array().cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    mixed = lambda own, wider, strength: F.zip_with(own, wider, lambda a, b: (a + b * strength) / (total(own) + strength))
    domains = by("domain").where("domain IS NOT NULL").select("domain", mixed(F.col("n"), arr(spread), DOMAIN_STRENGTH).alias("domain_prior"))
    wider = met.where("host IS NOT NULL").select("host", "domain").distinct().join(few(domains), "domain").groupBy("host").agg(F.min_by("domain_prior", "domain").alias("wider"))
    hosts = by("host").where("host IS NOT NULL").join(wider, "host", "left").select("host", mixed(F.col("n"), F.coalesce("wider", arr(spread)), HOST_STRENGTH).alias("host_prior"))
    # probability of a signal in each language: its share of the language's texts, next to its share of all
    signal = lambda c: by(c).where(f"{c} IS NOT NULL").select(c, F.zip_with(F.zip_with(F.col("n"), arr(whole), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), arr(spread), lambda x, _: (x.a + SIGNAL_STRENGTH * (total(F.col("n")) + 1) / F.lit(float(whole.sum() + 1))) / (x.b + SIGNAL_STRENGTH)).alias(f"{c}_says"))
    rows = scored.join(few(hosts), "host", "left").join(few(domains), "domain", "left").join(few(signal("declared")), "declared", "left").join(few(signal("suffix")), "suffix", "left")
    prior = F.coalesce("host_prior", "domain_prior", arr(spread))
    names = [*languages, UNKNOWN]

    @F.pandas_udf("lang_id string, probability double, text_lang string")
    def decide(likes: pd.Series, priors: pd.Series, declared_says: pd.Series, suffix_says: pd.Series) -> pd.DataFrame:
        out = []
        for like, p, *says in zip(likes, priors, declared_says, suffix_says):
            if like is None or not k:
                out.append((UNKNOWN, 1.0, UNKNOWN))
                continue
            post = like.astype(np.float64)
            post[:-1] += np.log(np.asarray(p) * (1 - NONE_PRIOR))
            post[-1] += np.log(NONE_PRIOR)
            for s in says:
                if s is not None:
                    post[:-1] += np.log(s)
                    post[-1] += np.log(np.dot(s, spread))
            q = np.exp(post - post.max())
            q /= q.sum()
            i = int(np.argmax(q))
            out.append((names[i], float(q[i]), names[int(np.argmax(like))]))
        return pd.DataFrame(out, columns=["lang_id", "probability", "text_lang"])

    done = rows.select("id", *(f"keep_{c}" for c in keep), decide("like", prior, "declared_says", "suffix_says").alias("found")).select("id", *(f"keep_{c}" for c in keep), "found.*")
    accepted = (F.col("lang_id") != UNKNOWN) & (F.col("probability") >= ACCEPT)
    return done.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep if c != id_col), "lang_id", "probability", "text_lang", accepted.alias("accepted"))
