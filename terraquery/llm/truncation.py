"""Text cut off by field limits or a broken transfer.

Each text is reduced once to what its end shows: the length before anything that may have
been added after a cut, whether its own structure proves it cut or whole (header block,
multipart boundary, encoded block), and otherwise its last line.  Then

* discrete length hazards h(L) = texts of length L / texts of length L or more are
  computed per source by window functions, in characters and in bytes, and each is
  tested against the hazards of its neighbours, with false-discovery control: these
  are the lengths at which a source cuts;
* at a significant length a text is cut if its ending is incomplete: it is not, where
  the structure proves it whole or where a whole last line is closed by a line break;
* a remark or dots behind which texts mostly have a significant length are what a program
  adds where it cuts; no list of them is needed;
* a text that broke off at no common length, as a broken transfer leaves it, can't be
  found by lengths: it is cut if it bears such a remark or its ending is incomplete in
  itself.  ``why`` tells these from those found by length.

A last line is whole if it ends as a sentence does, if it is a short remark of its own,
or if other texts end with it, too: which names, greetings and signature lines, in any
language, end a text is learnt from the texts that end with a line break.
"""

from __future__ import annotations

import base64
import binascii
import math
import quopri
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line above what a mailing list or gateway adds below a text, in up to three lines.
_RULE = re.compile(r"[_=-]{20,}")
# What may be a program's remark at the end of a line; the corpus tells whether it is.
_REMARK = re.compile(r"(\[[^\[\]]+\]|\([^()]+\)|\.\.\.|…)$")
_QUOTE = re.compile(r"^\s*(?:[>|]\s?)+")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"\n]+)"|([^\s;"]+))', re.I)
_ENCODING = re.compile(r"^content-transfer-encoding:\s*([\w-]+)", re.I | re.M)
_OCTET = re.compile(r"=[0-9A-F]{2}")
_PART = re.compile(r"\s*(--[^\s]{4,70})\n(?:Content-[A-Za-z-]+:)", re.I)
_HEADER = re.compile(r"^(?:From |[A-Za-z][A-Za-z0-9-]*:)")
_ENDS = tuple(".!?。！？…)]}”»\"')）】」")
_INITIAL = re.compile(r"^[-–—~]\s?[^\W\d_]{1,3}$")
_NAME = re.compile(r"^(?:[^\W\d_][^\s\d]*)(?: [^\W\d_][^\s\d]*){0,2}$")

FEATURES = "core_chars int, core_bytes int, text_hash long, proof string, terminated boolean, mark string, ends_well boolean, line_key string, mask_key string, before_key string, named boolean, remark boolean, body_hash long"


def _keyed(line: str) -> str:
    """A whole last line for comparison: without quoting marks, digits and mail names."""
    t = _QUOTE.sub("", line).strip()
    t = re.sub(r"[\w.+-]+@", "@", t)
    return re.sub(r"\d+", "9", t)


def _short(key: str) -> str:
    """A key as it is stored: beyond 200 characters its beginning, length and hash."""
    return key if len(key) <= 200 else f"{key[:160]} #{len(key)} {hash_text(key)}"


def _mask(key: str) -> str:
    """A labelled line with its capitalised words masked, so that it stands for its kind."""
    label, sep, rest = key.partition(": ")
    return label + sep + re.sub(r"[^\W\d_a-z][^\W\d_]+", "A", rest) if sep and len(label) <= 30 else ""


def without_footer(text: str) -> str:
    """The text without a rule and one to three lines below it at its end."""
    p = text.rstrip().rsplit("\n", 4)
    for below in (3, 2, 1):
        if len(p) > below + 1 and _RULE.fullmatch(p[-below - 1]) and all(p[-below:]):
            return "\n".join(p[:-below - 1])
    return text


def _repaired(line: str) -> str:
    """A line whose UTF-8 was taken for a one-byte code, as it should read."""
    if not line.isascii():
        for code in ("latin-1", "cp1252"):
            try:
                return line.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return line


def _rereads(tail: str) -> list[str]:
    """The tail as it is and as it reads where UTF-8 was taken for a one-byte code."""
    out = [tail]
    for code in ("latin-1", "cp1252"):
        for skip in range(4):
            try:
                out.append(tail[skip:].encode(code).decode("utf-8"))
                break
            except UnicodeError:
                continue
    return out


def _capital(word: str) -> bool:
    return not word[:1].islower()


def ending(text: str | None) -> tuple | None:
    """What the end of one text shows; None for a null, empty or blank text."""
    if text is None or not text.strip():
        return None
    core = without_footer(text)
    mark = dots = None
    last = core.rstrip()
    if m := _REMARK.search(last, last.rfind("\n") + 1):
        whole_line, terminated = last[last.rfind("\n") + 1:], core.endswith("\n")
        quoted, core = _QUOTE.match(whole_line), last[: m.start()].rstrip()
        alone = _QUOTE.sub("", whole_line).strip() == m.group()
        mark = _short(("line " if alone else "") + re.sub(r"\d+", "9", m.group()))
        dots = m.group() in ("...", "…") and not quoted
    size = (len(core), len(core.encode("utf-8", "surrogatepass")))
    digest = hash_text(core)

    def shown(proof: str, **x) -> tuple:
        d = {"body_hash": digest, "terminated": False, "ends_well": False, "line_key": None, "mask_key": None, "before_key": None, "named": False, "remark": False} | x
        return (*size, digest, proof, d["terminated"], mark, d["ends_well"], d["line_key"], d["mask_key"], d["before_key"], d["named"], d["remark"], d["body_hash"])

    head, sep, body = core.partition("\n\n")
    if not sep and "\r\n\r\n" in core:
        head, sep, body = core.partition("\r\n\r\n")
    if _HEADER.match(head):
        if not sep:
            return shown("cut")
        b = _BOUNDARY.search(head)
        first = _PART.match(body)  # a multipart body whose header was lost
        if b or first:
            boundary = "--" + (b.group(1) or b.group(2)) if b else first.group(1)
            if re.search(r"(?m)^" + re.escape(boundary) + r"--\s*$", body):
                return shown("whole")
            return shown("cut")
        how = m.group(1).lower() if (m := _ENCODING.search(head)) else ""
        if how == "base64":
            data = "".join(body.split())
            if len(data) % 4:
                return shown("cut")
            try:
                body = base64.b64decode(data, validate=True).decode("utf-8")
            except (binascii.Error, UnicodeError):
                return shown("cut" if not data.endswith("=") else "whole")
        encoded = how == "quoted-printable" or not how and "=\n" in body and len(_OCTET.findall(body)) > 2
        if encoded and re.search(r"=[0-9A-Fa-f]?\s*$", body):
            return shown("cut")
        if encoded:
            raw = quopri.decodestring(body.encode("utf-8", "surrogatepass"))
            body = raw.decode("utf-8", "replace")
    else:
        body = core
    lines = body.rstrip().split("\n")
    line, before = lines[-1], next((x for x in reversed(lines[:-1]) if _QUOTE.sub("", x).strip()), "")
    if mark:  # perhaps the writer's own
        line = whole_line
    else:
        terminated = core.endswith("\n")
    line, before = _repaired(line), _repaired(before)
    key = _keyed(line)
    plain = _QUOTE.sub("", line).strip()
    named = bool(_NAME.match(plain)) and all(map(_capital, plain.split())) and len(plain) <= 40
    if named:
        rest = core[: len(core) - len(line)].lower()
        named = all(re.search(r"(?<!\w)" + re.escape(w.lower()) + r"(?!\w)", rest) for w in plain.split())
    # a short line of its own, in lower case as no sentence begins, or initials behind a dash
    alone = len(lines) < 2 or not _QUOTE.sub("", lines[-2]).strip()
    remark = alone and (plain[:1].islower() and len(plain) <= 40 and "://" not in plain or _INITIAL.match(plain) is not None)
    tail = plain[-40:]
    well = not plain or (not dots and any(t.rstrip().endswith(_ENDS) for t in _rereads(tail)) and not re.search(r"(?:^|\s)\d+\.$", tail))
    if not mark and core[-1:].isspace() and not core.endswith("\n"):
        well = not plain  # a line that goes on behind a blank
    return shown("open", body_hash=_body_hash(body), terminated=terminated, ends_well=well, line_key=_short(key), mask_key=_short(_mask(key)) or None, before_key=_short(_keyed(before)), named=named, remark=remark)


def _body_hash(body: str) -> int:
    """Hash of a text without its headers, the same for copies that differ in blanks or decoding."""
    if not body.isascii():
        body = "\n".join(map(_repaired, body.split("\n")))
    return hash_text(" ".join(body.split()))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def source_name(c: Column) -> Column:
    """Source without outer blanks and case; null and blank become one empty name."""
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def endings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One narrow row per non-blank text: ``doc_id``, ``source`` and what its end shows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        for pdf in batches:
            seen = [(i, s, *e) for i, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"]) if (e := ending(t)) is not None]
            yield pd.DataFrame(seen, columns=["doc_id", "source", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(read, f"doc_id {kind}, source string, {FEATURES}")


def cut_lengths(ends: DataFrame, window: int = 64, fdr: float = 0.01) -> DataFrame:
    """Lengths at which a source cuts: ``source, unit, length, n, hazard, expected, p``.

    n counts different texts, so copies of one text make no peak.  Its expectation comes
    from the hazards of the lengths within ``window`` on both sides, those found to be
    significant themselves left out; p is the Chernoff bound of the Poisson tail, and the
    Benjamini-Hochberg step keeps the false-discovery rate of each source and unit below
    ``fdr``.  The windows run over histograms, which have a row per distinct length and
    not per text.
    """
    each = ends.select("source", "core_chars", "core_bytes", "text_hash").distinct()
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"core_{u}").alias("length")) for u in ("chars", "bytes")]))
    hist = each.select("source", units.alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    # few bytes but wide windows: a number of partitions that is given is not coalesced into one task
    hist = hist.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "unit")
    by = Window.partitionBy("source", "unit").orderBy("length")
    hist = hist.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("peak", F.lit(False))
    near = by.rangeBetween(-window, window)
    # the first round finds peaks, the second tests every length without them among its neighbours
    for _ in range(2):
        aside = F.when(F.col("peak"), 1).otherwise(0)
        hist = hist.withColumn("around", F.sum(F.when(F.col("peak"), 0).otherwise(F.col("n"))).over(near) - F.when(F.col("peak"), 0).otherwise(F.col("n")))
        # exposure of the neighbours: at_risk below the length, at_risk less its own texts above it
        lengths = F.lit(2 * window) - (F.sum(aside).over(near) - aside)
        exposure = lengths / 2 * (F.col("at_risk") * 2 - F.col("n")) + F.lit(1)
        hist = hist.withColumn("expected", F.col("at_risk") * (F.col("around") + 0.5) / exposure)
        n, e = F.col("n").cast("double"), F.col("expected")
        hist = hist.withColumn("p", F.when(n > e, F.exp(n - e - n * F.log(n / e))).otherwise(1.0))
        whole = Window.partitionBy("source", "unit")
        hist = hist.withColumn("rank", F.row_number().over(whole.orderBy("p", "length"))).withColumn("tests", F.count(F.lit(1)).over(whole))
        hist = hist.withColumn("bh", F.max(F.when(F.col("p") <= F.lit(fdr) * F.col("rank") / F.col("tests"), F.col("rank"))).over(whole))
        hist = hist.withColumn("peak", F.coalesce(F.col("rank") <= F.col("bh"), F.lit(False)))
    return hist.where("peak").select("source", "unit", "length", "n", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected", "p")


#: Share of all texts that must end with a line for it to be known as a last line.  It is a
#: share because cut texts agree by chance in proportion to their number.
KNOWN_SHARE = 2e-5
#: Different texts that a remark must end, and the share of them at significant lengths.
REMARK_TEXTS, REMARK_SHARE = 3, 0.5


def flag_truncated(ends: DataFrame, lengths: DataFrame, share: float = KNOWN_SHARE) -> DataFrame:
    """``doc_id, source, truncated, why`` for each row of ``endings``.

    ``why`` is limit (incomplete at a significant length), structure, mark or ending, null
    for a whole text.  A known last line is one that at least two different texts, and
    ``share`` of all, end with before a line break, headers aside; a text cut there and
    closed by a line break does not make its own fragment known, however many copies of it
    there are.
    """
    seen = max(2, math.ceil(share * ends.select("body_hash").distinct().count()))
    is_open = F.col("proof") == "open"
    model = ends.where(is_open & F.col("terminated") & F.col("line_key").isNotNull())
    lines_ = model.select(F.lit("line").alias("kind"), F.col("line_key").alias("key"), "body_hash")
    masks = model.where("mask_key is not null").select(F.lit("mask").alias("kind"), F.col("mask_key").alias("key"), "body_hash")
    before = model.where("named").select(F.lit("before").alias("kind"), F.col("before_key").alias("key"), "body_hash")
    known = lines_.unionByName(masks).unionByName(before).distinct().groupBy("kind", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= seen)

    # rows without a key match nothing; a key of their own keeps them from meeting in one task
    alone = F.concat(F.lit("\u0000"), F.xxhash64("doc_id", "text_hash").cast("string"))

    def having(df: DataFrame, side: DataFrame, col: str, name: str) -> DataFrame:
        side = side.select(F.col("key").alias("__key"), F.lit(True).alias(f"has_{name}"))
        return df.withColumn("__key", F.coalesce(F.col(col), alone)).join(side, "__key", "left").drop("__key")

    df = ends
    for unit in ("chars", "bytes"):
        side = lengths.where(F.col("unit") == unit).select("source", F.col("length").alias(f"core_{unit}"), F.lit(True).alias(f"at_{unit}"))
        df = df.join(side, ["source", f"core_{unit}"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = df.withColumn("at_limit", yes("at_chars") | yes("at_bytes"))
    remarks = df.where("mark is not null").groupBy("mark", "body_hash").agg(F.max("at_limit").alias("at_limit"))
    remarks = remarks.groupBy(F.col("mark").alias("key")).agg(F.count(F.lit(1)).alias("c"), F.avg(F.col("at_limit").cast("double")).alias("share"))
    df = having(df, remarks.where((F.col("c") >= REMARK_TEXTS) & (F.col("share") >= REMARK_SHARE)), "mark", "mark_of_cut")
    for kind, col in (("line", "line_key"), ("mask", "mask_key"), ("before", "before_key")):
        df = having(df, known.where(F.col("kind") == kind), col, kind)
    whole_line = F.col("ends_well") | F.col("remark") | yes("has_line") | yes("has_mask") | (yes("has_before") & F.col("named"))
    marked = yes("has_mark_of_cut")
    cut = F.col("proof") == "cut"
    complete = whole_line & F.col("terminated") & ~marked
    why = (
        F.when(F.col("at_limit") & (cut | is_open & ~complete), "limit")
        .when(cut, "structure").when(is_open & marked, "mark").when(is_open & ~whole_line, "ending"))
    return df.select("doc_id", "source", why.isNotNull().alias("truncated"), why.alias("why"))


def truncation_rates(docs: DataFrame, flagged: DataFrame, source: str = "source") -> DataFrame:
    """Per source all texts, those cut, and their share; blank texts count as not cut."""
    alls = docs.groupBy(source_name(F.col(source)).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    cut = flagged.where("truncated").groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    df = alls.join(cut, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return df.select("source", "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"))
