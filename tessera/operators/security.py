"""Secret detection, masking and reports.

Every pattern has something that its matches must hold: a literal, or a long
run of letters and digits. One automaton over all literals reads the texts in
Arrow batches, and a line meets only the patterns whose mark it holds; lines
without a mark end there. The patterns themselves run in the JVM, with the
offsets of every match; only lines with a match are shuffled, by chunk and line
number. Every occurrence is kept. Reports aggregate small rows.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secrets as S
from ..sources.shared import spread

#: Marks of test files and example values; they lower the confidence.
TEST_PATH, EXAMPLE, LOWERED = r"(?i)(^|/)tests?(/|_)|test_|_test\.", r"(?i)(example|sample|dummy|placeholder|changeme|your[_-])", 0.3


#: Letters of a literal, and of a run of letters and digits, that make a mark.
LITERAL, RUN = 3, 20


def required(pattern: str) -> str | int | None:
    """What every match of a pattern must hold: its longest literal in lower case, or else the length of its longest run of letters and digits (RUN at least); None if neither is known."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:  # only Java knows it
        return None
    literals, runs, held, run = [], [0], [], 0

    def walk(nodes) -> None:
        nonlocal run
        for kind, value in nodes:
            name = str(kind)
            if name == "SUBPATTERN":
                walk(value[-1])
                continue
            one = value[2][0] if name == "MAX_REPEAT" and len(value[2]) == 1 else (kind, value)
            times = value[0] if name == "MAX_REPEAT" else 1
            if name == "LITERAL":
                held.append(chr(value))
            else:
                literals.append("".join(held))
                held.clear()
            run = run + times if times and (str(one[0]) == "IN" and _letters(one[1]) or str(one[0]) == "LITERAL" and _letters([one])) else 0
            runs.append(run)

    walk(tree)
    literals.append("".join(held))
    best = max(literals, key=len).lower()
    if len(best) >= LITERAL and best.isascii():
        return best
    return max(runs) if max(runs) >= RUN else None


def _letters(members: list) -> bool:
    """Whether a class has only letters and digits."""
    for kind, value in members:
        low, high = value if str(kind) == "RANGE" else (value, value) if str(kind) == "LITERAL" else (0, 0)
        if not (chr(low).isalnum() and chr(high).isalnum() and high < 128):
            return False
    return True


@lru_cache(maxsize=8)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, x in enumerate(literals):
        found.add_word(x, k)
    found.make_automaton()
    return found


def _candidates(chunks: DataFrame, catalogue: list[tuple]) -> DataFrame:
    """chunk_id, file_path, line_number, line, patterns (numbers of those that may match) of lines with a mark."""
    needs = [required(p[4]) for p in catalogue]
    literals = tuple(sorted({x for x in needs if isinstance(x, str)}))
    of_literal = [[k for k, x in enumerate(needs) if x == text] for text in literals]
    lengths = sorted({x for x in needs if isinstance(x, int)})
    of_run = [(re.compile(rf"[A-Za-z0-9]{{{n}}}"), [k for k, x in enumerate(needs) if x == n]) for n in lengths]
    always = [k for k, x in enumerate(needs) if x is None]
    id_type = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        marks = _automaton(literals) if literals else None
        for batch in batches:
            rows, numbers, lines, patterns = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                breaks = [m.start() for m in re.finditer("\n", text)]
                hits: dict[int, set[int]] = {n: set(always) for n in range(len(breaks) + 1)} if always else {}
                if marks is not None:
                    low = text.encode().lower().decode()  # A-Z alone, so offsets stay
                    for at, j in marks.iter(low):
                        hits.setdefault(bisect_right(breaks, at), set()).update(of_literal[j])
                for shape, which in of_run:
                    for m in shape.finditer(text):
                        hits.setdefault(bisect_right(breaks, m.start()), set()).update(which)
                for n in sorted(hits):
                    rows.append(k)
                    numbers.append(n + 1)
                    lines.append(text[breaks[n - 1] + 1 if n else 0 : breaks[n] if n < len(breaks) else len(text)])
                    patterns.append(sorted(hits[n]))
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), pa.array(patterns, pa.list_(pa.int32()))], names=["chunk_id", "file_path", "line_number", "line", "patterns"])

    return chunks.mapInArrow(run, f"chunk_id {id_type}, file_path string, line_number int, line string, patterns array<int>")


def _matched(rows: DataFrame, catalogue: list[tuple]) -> DataFrame:
    """All matches of the candidates, upper and lower case alike, with the offset of the secret: the pattern's group if there is one.

    The gaps between the matches and the matches' own lengths add up to the
    offsets; the part of a match before its group is made a group too.
    """
    table = []
    for k, (_, kind, name, confidence, pattern) in enumerate(catalogue):
        group = _group(pattern)
        table.append((k, kind, name, float(confidence), f"(?i){pattern}", f"(?i){pattern}" if group is None else f"(?i)({pattern[:group]}){pattern[group:]}", group is not None))
    patterns = rows.sparkSession.createDataFrame(table, "k int, secret_type string, pattern_name string, confidence double, p string, parted string, grouped boolean")
    each = rows.select("chunk_id", "file_path", "line_number", "line", F.explode("patterns").alias("k")).join(F.broadcast(patterns), "k").where(F.rlike("line", F.col("p")))
    pick = lambda n: F.regexp_extract_all("line", F.col("parted"), F.lit(n))
    whole = F.regexp_extract_all("line", F.col("p"), F.lit(0))
    each = each.withColumns({"whole": whole, "gaps": F.split("line", F.col("p"), -1), "found": F.when(F.col("grouped"), pick(2)).otherwise(whole), "before": F.when(F.col("grouped"), pick(1))})
    length = lambda parts: F.length(F.concat_ws("", parts))

    def at(m: Column, i: Column) -> Column:
        start = length(F.slice("gaps", F.lit(1), i + 1)) + length(F.slice("whole", F.lit(1), i)) + F.coalesce(F.length(F.get("before", i)), F.lit(0))
        return F.struct(m.alias("content"), start.cast("int").alias("start_position"))

    return each.select("chunk_id", "file_path", "line_number", "line", "secret_type", "pattern_name", "confidence", F.inline(F.transform("found", at)))


def sound_patterns(spark: SparkSession, custom: tuple) -> list[tuple]:
    """The custom rows whose pattern Java can compile; a warning names the others."""
    good = []
    for entry in custom:
        try:
            spark._jvm.java.util.regex.Pattern.compile(entry[4])
            good.append(entry)
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"pattern {entry[2]} is left out: {str(error)[:200]}", stacklevel=2)
    return good


def _group(pattern: str) -> int | None:
    """Where the secret's group begins in a pattern; an optional group is none."""
    k, in_class = 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            k += pattern[k + 1 : k + 2] in ("]", "^")
        elif c == "(" and pattern[k + 1 : k + 2] != "?":
            return None if re.match(r"\((?:\\.|[^()\\])*\)[?*]", pattern[k:]) else k
        k += 1
    return None


def _of_type(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["secret_type"] == kind


def detect(chunks: DataFrame, id_column: str = "chunk_id", content: str = "content", path: str | None = "file_path", framework: str | None = None, env: bool = False, threshold: float = 0.7, whitelist: tuple[str, ...] = (), custom: tuple = ()) -> DataFrame:
    """One row for each secret: id, type, pattern, confidence, line and position, content, context.

    ``custom`` adds rows as in the catalogue; what a ``whitelist`` pattern
    matches is left out; confidence below ``threshold`` too. Of overlapping
    matches the longest stays, then the most confident, then the left-most. A
    custom pattern that can't be compiled is left out with a warning.
    """
    catalogue = [*S.patterns_for(framework, env), *sound_patterns(chunks.sparkSession, custom)]
    texts = chunks.select(F.col(id_column).alias("chunk_id"), (F.col(path) if path else F.lit("")).alias("file_path"), F.col(content).alias("content"))
    rows = _matched(_candidates(spread(texts), catalogue), catalogue).where(F.col("content") != "")
    lowered = F.col("file_path").rlike(TEST_PATH) | F.col("content").rlike(EXAMPLE)
    rows = rows.withColumn("confidence", F.round(F.when(lowered, F.col("confidence") - LOWERED).otherwise(F.col("confidence")), 6)).where(F.col("confidence") >= threshold)
    for w in whitelist:
        rows = rows.where(~F.col("content").rlike(w))
    placed = rows.withColumn("context", F.substring("line", 1, 200)).withColumn("end_position", F.col("start_position") + F.length("content"))
    best = F.struct("start_position", "end_position", "secret_type", "pattern_name", "confidence", "content")
    # only lines with a match meet, by chunk and number
    many = placed.groupBy("chunk_id", "file_path", "line_number").agg(F.sort_array(F.collect_set(best)).alias("all_"), F.min("context").alias("context"))
    # of matches that overlap the longest stays, then the most confident, then the left-most
    order = lambda s: F.struct(s["end_position"] - s["start_position"], s["confidence"], -s["start_position"], s["pattern_name"])
    beaten = lambda s: F.exists("all_", lambda o: (o["start_position"] < s["end_position"]) & (s["start_position"] < o["end_position"]) & (order(o) > order(s)))
    rows = many.select("chunk_id", "file_path", "line_number", "context", F.explode(F.filter("all_", lambda s: ~beaten(s))).alias("b"))
    return rows.select("chunk_id", "file_path", "line_number", "b.*", "context")


def mask(chunks: DataFrame, found: DataFrame, id_column: str = "chunk_id", content: str = "content") -> DataFrame:
    """``chunks`` with masked content, secrets, masked_count and sensitivity_level; unchanged where nothing was found.

    Secrets of a line are replaced from the right; one that overlaps a masked
    one is left out of the replacement but stays in the list.
    """
    many = found.groupBy(F.col("chunk_id").alias("mask_id")).agg(F.sort_array(F.collect_list(F.struct("line_number", "start_position", "end_position", "secret_type", "confidence", "pattern_name"))).alias("secrets"))
    rows = chunks.join(many, F.col(id_column) == F.col("mask_id"), "left").drop("mask_id")
    holder = F.lit(S.OTHER_MASK)
    quoted = F.lit(True)
    placeholders = F.create_map(*[F.lit(x) for k, (p, _) in S.MASKS.items() for x in (k, p)])
    keeps = F.create_map(*[F.lit(x) for k, (_, q) in S.MASKS.items() for x in (k, q)])

    def one(line: Column, s: Column) -> Column:
        place, wants = F.coalesce(placeholders[s["secret_type"]], holder), F.coalesce(keeps[s["secret_type"]], quoted)
        before, after = F.substring(line, F.lit(1), s["start_position"]), F.substring(line, s["end_position"] + 1, F.length(line))
        q = F.substring(after, 1, 1)
        inside = q.isin('"', "'", "`") & before.endswith(q)
        return F.concat(before, F.when(wants & ~inside, F.concat(F.lit('"'), place, F.lit('"'))).otherwise(place), after)

    def masked_line(line: Column, n: Column) -> Column:
        own = F.filter("secrets", lambda s: s["line_number"] == n + 1)
        start = F.struct(line.alias("line"), F.lit(1 << 30).alias("free"))
        step = lambda acc, s: F.when(s["end_position"] <= acc["free"], F.struct(one(acc["line"], s).alias("line"), s["start_position"].cast("int").alias("free"))).otherwise(acc)
        return F.aggregate(F.reverse(own), start, step, lambda acc: acc["line"])

    masked = F.array_join(F.transform(F.split(F.col(content), "\n"), masked_line), "\n")
    has = F.col("secrets").isNotNull()
    return rows.withColumns({"original_length": F.length(content), "masked_count": F.coalesce(F.size("secrets"), F.lit(0)), "sensitivity_level": F.when(has, S.sensitivity_of(F.col("secrets"))).otherwise("LOW"), content: F.when(has, masked).otherwise(F.col(content))})


def scan(chunks: DataFrame, enabled: bool = True, **options) -> DataFrame:
    """Detect and mask; with ``enabled`` false the chunks come back with empty results."""
    if not enabled:
        return chunks.withColumns({"secrets": F.lit(None).cast("array<struct<line_number:int,start_position:int,end_position:int,secret_type:string,confidence:double,pattern_name:string>>"), "original_length": F.length("content"), "masked_count": F.lit(0), "sensitivity_level": F.lit("LOW")})
    return mask(chunks, detect(chunks, **options))


def report(scanned: DataFrame, path: str = "file_path") -> DataFrame:
    """One row: totals, files, sensitivity and type histograms, masked share, recommendations."""
    totals = scanned.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum(F.col("masked_count").cast("long")).alias("total_secrets"),
        F.count_distinct(F.when(F.col("masked_count") > 0, F.col(path))).alias("files_with_secrets"),
        *[F.count(F.when(F.col("sensitivity_level") == s, 1)).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")],
        *[F.sum(F.size(F.filter(F.coalesce("secrets", F.array()), _of_type(t))).cast("long")).alias(t) for t in ("private_key", "database_url", "password", "api_key")],
        F.round(F.sum(F.length("content")) / F.sum("original_length"), 6).alias("masking_ratio"),
    )
    return totals.withColumn("recommendations", recommendations())


def recommendations() -> Column:
    """Advice from a report's columns (fixed thresholds)."""
    say = lambda cond, text: F.when(cond, text)
    c = F.col
    rules = [
        say(c("total_secrets") == 0, "[OK] no secrets"),
        say(c("high") > 0, F.concat(F.lit("[CRITICAL] "), c("high").cast("string"), F.lit(" high-risk chunks"))),
        say(c("files_with_secrets") > 5, F.concat(F.lit("[WARN] "), c("files_with_secrets").cast("string"), F.lit(" files hold secrets"))),
        say(c("private_key") > 0, "[KEY] private keys"),
        say(c("database_url") > 0, "[DB] database URLs"),
        say(c("password") > 0, "[PASSWORD] passwords"),
        say(c("api_key") > 0, "[API] API keys"),
        say(c("total_secrets") > 20, "[RECOMMENDATION] scan automatically"),
        say(c("total_secrets") > 0, "[TIP] rotate secrets"),
    ]
    return F.array_compact(F.array(*rules))


def sensitive_files(scanned: DataFrame, path: str = "file_path") -> DataFrame:
    """path and whether any of its chunks is MEDIUM or HIGH."""
    return scanned.groupBy(path).agg(F.bool_or(F.col("sensitivity_level").isin("MEDIUM", "HIGH")).alias("sensitive"))


def masking_summary(found: DataFrame) -> DataFrame:
    """Number of secrets by type."""
    return found.groupBy("secret_type").agg(F.count(F.lit(1)).alias("n"))
