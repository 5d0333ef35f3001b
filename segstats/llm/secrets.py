"""Secret scan with corpus-wide ownership frequency.

One pass finds candidates in every whole text: base kinds (assign, access, hex) and provider formats. Their values are hashed and
counted over the corpus by distinct documents (each stands for a repository) and distinct owners. A value that at least
``shared_owners`` owners hold is a widely copied example; one that fewer hold and that looks random is live. Hot values are
pre-aggregated per owner before they meet, and joins on them are left to AQE's skew handling.

Literal probes on the UTF-8 bytes decide which pattern has to run at all. Patterns are linear in the length of a text.

Defined cases: a null or empty text has no findings; repeated rows are reported each and count as one document; a null owner is
an owner of its own; an empty table gives an empty result. Positions are code points, ends exclusive, of whole matches.
"""

from __future__ import annotations

import re
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import BROADCAST_ROWS, LOWER_BYTES, as_bytes, bounded_batches, map_rows, texts
from segstats.session import materialize

#: Owners from which on a value is a widely copied example.
SHARED_OWNERS = 3

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
#: Provider formats: kind, literals of which one must occur, pattern.
PROVIDERS = (
    ("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}+")),
    ("slack", (b"xox",), re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("google", (b"AIza",), re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("stripe", (b"sk_live_", b"rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}+")),
    ("jwt", (b"eyJ",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("pem", (b"PRIVATE KEY-----",), re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
)
KINDS = BASE + tuple(p[0] for p in PROVIDERS)
ORDER = {kind: k for k, kind in enumerate(KINDS)}

FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:binary,random:boolean>>"


def random_looking(value: str) -> bool:
    """Letters and digits mixed, and many different characters."""
    return (
        len(set(value)) >= min(8, 1 + len(value) // 2)
        and any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
    )


def scan(raw: bytes) -> list[tuple[int, int, int, str, str]]:
    """``(start, rank, end, kind, value)`` of all findings in a text, sorted."""
    probes = {}
    low = raw.translate(LOWER_BYTES)
    probes["assign"] = any(w in low for w in ASSIGN_WORDS)
    probes["access"] = b"AKIA" in raw
    probes["hex"] = b"h" * 32 in raw.translate(HEX_BYTES)
    named = [(kind, pattern) for kind, words, pattern in PROVIDERS if any(w in raw for w in words)]
    if not named and not any(probes.values()):
        return []
    text, out = raw.decode(), []
    if probes["assign"]:
        out += [(m.start(), 0, m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if probes["access"]:
        out += [(m.start(), 1, m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if probes["hex"]:
        out += [(m.start(), 2, m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    for kind, pattern in named:
        out += [(m.start(), ORDER[kind], m.end(), kind, m[0]) for m in pattern.finditer(text)]
    return sorted(out)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """One row per document with its base counts, digest and findings; written once, since row ids must not change."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = as_bytes(
        texts(docs, id_col, text_col, F.col(owner_col).cast("string").alias("owner")), "owner"
    ).select("*", F.xxhash64("text").alias("text_hash"))

    def rows(stream):
        for doc, raw, owner, text_hash in stream:
            found = scan(raw)
            base = [f for f in found if f[1] < len(BASE)]
            said = ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in base)
            count = [sum(f[3] == k for f in base) for k in BASE]
            full = [
                {"start": s, "rank": r, "end": e, "kind": k, "value": blake2b(v.encode(), digest_size=16).digest(), "random": random_looking(v)}
                for s, r, e, k, v in found
            ]
            yield doc, owner, text_hash, *count, sha256(said.encode()).hexdigest(), full

    schema = f"doc_id {kind}, owner string, text_hash bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {FOUND}"
    out = map_rows(source, schema, rows)
    return materialize(out.withColumn("row_id", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_documents, n_owners)`` over the whole corpus; a hot value is one row per owner before it meets."""
    per_doc = found.select("doc_id", "text_hash", "owner", F.explode("found.value").alias("value")).distinct()
    per_owner = per_doc.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_owners"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    shared_owners: int = SHARED_OWNERS,
) -> DataFrame:
    """Per document: base counts and digest, and ``found``: all findings by start and kind, each with its ``status``.

    Status: ``example`` (many owners), ``live`` (few owners, looks random) or ``weak`` (few owners, does not).
    """
    rows = candidates(docs, id_col, text_col, owner_col)
    plain = ["row_id", "doc_id", "owner", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256"]
    some = rows.filter(F.size("found") > 0)
    each = some.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    status = (
        F.when(F.col("n_owners") >= shared_owners, "example").when(F.col("random"), "live").otherwise("weak")
    )
    told = each.join(ownership(some), "value").select(
        "row_id",
        F.struct("start", "rank", "end", "kind", status.alias("status"), "n_documents", "n_owners").alias("f"),
    )
    told = told.groupBy("row_id").agg(F.array_sort(F.collect_list("f")).alias("found"))  # bounded by one text's length
    done = some.select(*plain).join(told, "row_id")
    none = rows.filter(F.size("found") == 0).select(*plain, F.lit(None).cast(done.schema["found"].dataType).alias("found"))
    return done.select(*plain, "found").unionByName(none).withColumn(
        "found", F.coalesce("found", F.array().cast(done.schema["found"].dataType))
    ).drop("row_id")


def said(found: str) -> F.Column:
    """``kind:start:end`` of every finding, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    shared_owners: int = SHARED_OWNERS,
) -> DataFrame:
    """``docs`` with secrets replaced by ``[kind]``: base kinds always, provider formats unless they are shared examples."""
    findings = (
        find_secrets(docs, id_col, text_col, owner_col, shared_owners)
        .withColumn("found", F.filter("found", lambda f: (f["rank"] < len(BASE)) | (f["status"] != "example")))
        .filter(F.size("found") > 0)
        .select(
            F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
            F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"))).alias("__found"),
        )
        .dropDuplicates(["__id", "__hash"])
    )
    findings = materialize(findings, "findings")
    if (findings.agg(F.sum(F.size("__found"))).first()[0] or 0) <= BROADCAST_ROWS:
        findings = F.broadcast(findings)
    hashed = F.xxhash64(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    joined = docs.withColumn("__own", hashed).join(
        findings, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left"
    )
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            text, found = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [t if not f else cover(t, f) for t, f in zip(text, found)]
            columns = [*batch.columns[:place], pa.array(new, batch.schema.field(place).type), *batch.columns[place + 1:-1]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded_batches(joined.select(*names, "__found")).mapInArrow(run, docs.schema)


def cover(text: str, found: list[dict]) -> str:
    """Findings are sorted by start; what an earlier one has covered is not shown again."""
    out, at = [], 0
    for f in found:
        if f["start"] >= at:
            out += [text[at:f["start"]], "[", f["kind"], "]"]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])
