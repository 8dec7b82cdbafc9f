"""Secret scans: base patterns, and a battery of randomness tests with false-discovery control.

Long tokens are tested against the alphabet of the encoding that their
characters suggest: chi-squared uniformity, runs above and below the middle,
and serial correlation. Random tokens give uniform p-values, words give small
ones; how many tokens of an encoding and length can pass by chance is counted
over the whole corpus, and a length's tokens are reported from the p-value on
at which few enough are false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, materialize, whole_text

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Runs with '=' at the end only; the look-ahead sees past it, so that lengths are looked at again.
TOKEN = r"(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]+=*"
#: What a run that fits no encoding is taken apart into, in this order.
PARTS = (r"(?=[A-Za-z0-9_=-]{20})[A-Za-z0-9_-]+=*", r"(?=[A-Za-z0-9+/=]{20})[A-Za-z0-9+/]+=*", r"(?=[A-Za-z0-9=]{20})[A-Za-z0-9]+=*")
LEAST_TOKEN = 20
#: Encodings by name, pattern that the whole token must match, and alphabet in order; the first that fits is taken.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("letters", r"^(?:[a-z]+|[A-Z][a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
)
#: p-values are counted in so many bins; lengths in bands by powers of two; a band of fewer tokens is judged with others.
BINS, MAX_BAND, LEAST_IN_BAND = 50, 12, 60
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


# The functions up to find_tokens give SQL: built from columns, lambda by lambda, such nests take seconds to make.


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, merge: str) -> str:
    """For each of an array of n longs, ``merge`` (of x and y) of 0 and all elements before it.

    Blocks of about sqrt(n) elements are merged first, so an element costs about
    sqrt(n) steps and not one for each before it.
    """
    fold = lambda a, start, n: f"aggregate(slice({a}, {start}, {n}), 0L, (x, y) -> {merge})"
    block = lambda i: f"cast(floor({i} / r.w) as int)"
    both = "named_struct('a', a, 'w', greatest(cast(ceil(sqrt(size(a))) as int), 1))"
    blocks = f"transform(sequence(0, {block('size(r.a)')}), j -> {fold('r.a', 'j * r.w + 1', 'r.w')})"
    each = f"transform(r.a, (e, i) -> {_let(fold('b', '1', block('i')), 'x', _let(fold('r.a', block('i') + ' * r.w + 1', 'i % r.w'), 'y', merge))})"
    return _let(values, "a", _let(both, "r", _let(blocks, "b", each)))


def find_spans(text: str, pattern: str) -> str:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive."""
    p = _text(pattern)
    found = f"case when rlike({text}, {p}) then named_struct('v', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p})) end"
    # Before a match are the gaps up to it and the matches before it.
    gaps = "transform(slice(m.g, 1, size(m.v)), g -> cast(length(g) as bigint))"
    before = running(f"zip_with({gaps}, m.v, (g, v) -> g + length(v))", "x + y")
    placed = f"zip_with(m.v, zip_with({before}, {gaps}, (s, g) -> s + g), (v, s) -> named_struct('start', s, 'end', s + length(v), 'value', v))"
    return _let(found, "m", f"case when m is null then cast(array() as {SPANS}) else {placed} end")


def without(spans: str, others: str) -> str:
    """Those of ``spans`` that overlap none of ``others``; ``spans`` don't overlap each other, and come back by start.

    Both are put in one order, in which the greatest end so far tells of an
    overlap. They are evaluated more than once: give variables or columns.
    """
    events = f"""array_sort(concat(
      transform({spans}, s -> named_struct('at', s.end, 'kind', 0, 'span', s, 'reach', 0L)),
      transform({others}, o -> named_struct('at', o.start, 'kind', 1, 'span', null, 'reach', o.end))))"""
    reach = running("transform(e, z -> z.reach)", "greatest(x, y)")
    free = f"transform(filter(zip_with(e, {reach}, (z, f) -> named_struct('span', z.span, 'free', z.kind = 0 and f <= z.span.start)), z -> z.free), z -> z.span)"
    return f"case when size({spans}) = 0 or size({others}) = 0 then {spans} else {_let(events, 'e', free)} end"


def encoding_of(token: str) -> str:
    """Number of the first encoding that the token fits; null if there is none."""
    return "case " + " ".join(f"when rlike({token}, {_text(pattern)}) then {i}" for i, (_, pattern, _) in enumerate(ENCODINGS)) + " end"


def token_parts(text: str) -> str:
    """struct<whole, part0, ...>: long runs that fit an encoding, and what fits of the others for each of PARTS."""
    is_long = lambda s: f"length({s}.value) >= {LEAST_TOKEN}"
    fit = lambda s: f"{encoding_of(s + '.value')} is not null"

    def parts(pattern: str) -> str:
        inner = f"filter({find_spans('o.value', pattern)}, t -> {is_long('t')} and {fit('t')})"
        moved = f"transform({inner}, t -> named_struct('start', o.start + t.start, 'end', o.start + t.end, 'value', t.value))"
        return f"flatten(transform(filter(q, o -> {is_long('o')} and not ({fit('o')})), o -> {moved}))"

    fields = [f"'whole', filter(q, o -> {is_long('o')} and {fit('o')})", *[f"'part{i}', {parts(pattern)}" for i, pattern in enumerate(PARTS)]]
    return _let(find_spans(text, TOKEN), "q", f"named_struct({', '.join(fields)})")


def chosen_tokens(parts: str) -> str:
    """The whole runs of :func:`token_parts`, and of the parts those that overlap none of an earlier kind."""
    out = f"{parts}.part0"
    for i in range(1, len(PARTS)):
        out = _let(f"named_struct('out', {out}, 'more', {parts}.part{i})", "u", f"concat(u.out, {without('u.more', 'u.out')})")
    return f"sort_array(concat({parts}.whole, {out}))"


def find_tokens(text: Column) -> Column:
    """Spans of tokens that fit an encoding in a column of texts: whole runs, and parts of those runs that fit none."""
    return F.expr(_let(token_parts(text._jc.toString()), "c", chosen_tokens("c")))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), to within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """struct<encoding, n, chi, runs, serial, p> of a token; null if it fits no encoding.

    The three p-values are of a random token of the encoding; ``p`` is their
    least, adjusted for taking the least of three. There is one battery; the
    encoding's name and alphabet are looked up.
    """
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k")) for name, _, alphabet in ENCODINGS])

    def tested(e: Column) -> Column:
        plain = F.when(e["name"] == "letters", F.lower(token)).otherwise(F.regexp_replace(token, "=+$", ""))

        def numbers(c: Column) -> Column:
            x = F.transform(c, lambda ch: F.instr(e["alphabet"], ch) - 1)
            squares = F.aggregate(F.array_distinct(c), F.lit(0.0), lambda a, ch: a + F.pow(F.size(F.filter(c, lambda y: y == ch)), F.lit(2.0)))
            return F.struct(x.alias("x"), squares.alias("squares"), F.size(c).cast("double").alias("n"), e["k"].alias("k"), ((e["k"] - 1) / 2).alias("mid"))

        def sums(v: Column) -> Column:
            pair = F.zip_with(F.slice(v["x"], F.lit(1), F.size(v["x"]) - 1), F.slice(v["x"], F.lit(2), F.size(v["x"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            mid = v["mid"]
            changes = F.aggregate(pair, F.lit(0.0), lambda s, p: s + F.when((p["a"] > mid) != (p["b"] > mid), 1.0).otherwise(0.0))
            lagged = F.aggregate(pair, F.lit(0.0), lambda s, p: s + (p["a"] - mid) * (p["b"] - mid))
            high = F.aggregate(v["x"], F.lit(0.0), lambda s, a: s + F.when(a > mid, 1.0).otherwise(0.0))
            return F.struct(v["n"].alias("n"), v["k"].alias("k"), v["squares"].alias("squares"), changes.alias("changes"), lagged.alias("lagged"), high.alias("high"))

        def p_values(s: Column) -> Column:
            n, k = s["n"], s["k"]
            df = k - 1
            chi = s["squares"] * k / n - n
            p_chi = _normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
            low = n - s["high"]
            both = 2 * s["high"] * low
            spread = both * (both - n) / (n * n * (n - 1))
            p_runs = F.when(spread > 0, 2 * _normal_tail(F.abs(s["changes"] - both / n) / F.sqrt(spread))).otherwise(0.0)
            p_serial = 2 * _normal_tail(F.abs(s["lagged"] / ((k * k - 1) / 12)) / F.sqrt(n - 1))
            # The least of three counts three times; runs and serial correlation can exceed 1 by the approximation.
            least = F.least(p_chi, F.least(p_runs, F.lit(1.0)), F.least(p_serial, F.lit(1.0)))
            return F.struct(e["name"].alias("encoding"), n.cast("int").alias("n"), p_chi.alias("chi"), p_runs.alias("runs"), p_serial.alias("serial"), (1 - F.pow(1 - least, F.lit(3.0))).alias("p"))

        return let(let(let(F.array_remove(F.split(plain, ""), ""), numbers), sums), p_values)

    fits = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        fits = F.when(token.rlike(pattern), i).otherwise(fits)
    return let(fits, lambda i: F.when(i.isNotNull(), let(F.get(table, i), tested)))


def _least_p(n: list[int], max_false: float) -> float | None:
    """The least p, by bins, from which on the share of false tokens is at most ``max_false``."""
    random = 2 * sum(n[BINS // 2 :])
    for b in range(BINS):
        accepted = sum(n[b:])
        if accepted and (accepted - min(accepted, random * (1 - b / BINS))) / accepted <= max_false:
            return b / BINS
    return None


def thresholds(candidates: DataFrame, max_false: float) -> dict[tuple[str, int], float]:
    """The p-value from which tokens count, by encoding and length band.

    ``candidates`` has encoding, band and p. Over half of the random tokens
    have p over 0.5, and so their number follows; what a band has beyond them from
    some p on is false. The least p at which the share of false tokens is at
    most ``max_false`` is taken; bands without one are left out. A band of under
    LEAST_IN_BAND tokens says too little by itself: it is judged by all bands of
    its encoding, and an encoding of as few by all tokens. At most encodings x
    bands x bins counts come to the driver.
    """
    counts: dict[tuple[str, int], list[int]] = {}
    bins = candidates.groupBy("encoding", "band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    for r in bins.collect():
        counts.setdefault((r.encoding, r.band), [0] * BINS)[r.bin] += r.n
    together = lambda lists: [sum(x) for x in zip(*lists, strict=True)]
    out = {}
    for (encoding, band), own in counts.items():
        wider = [own, together(n for (e, _), n in counts.items() if e == encoding), together(counts.values())]
        n = next((w for w in wider if sum(w) >= LEAST_IN_BAND), wider[-1])
        p = _least_p(n, max_false)
        if p is not None:
            out[encoding, band] = p
    return out


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_false: float = 0.05) -> DataFrame:
    """Spans of secrets in each document: doc_id, ``base`` and ``added``.

    Both are array<struct<start, kind, end>> by start, then kind as listed;
    ``kind`` is 0 assign, 1 access, 2 hex, and 3 random for what the tests add
    where no base span overlaps. Null texts count as empty and have no spans.
    Ties and repeated rows each give their own row, an empty table none, and
    other columns are ignored, whatever their names. Texts are scanned whole, in
    time that grows with their length and number of matches. Tokens of a length
    and encoding where false ones can't be told from random ones are not added.
    """
    t = whole_text(text)
    struct = "array<struct<start:bigint,kind:int,end:bigint>>"

    def base(kind: int) -> str:
        _, pattern, group, least = BASE[kind]
        # The pattern again on the match alone gives its group.
        value = f"regexp_extract(s.value, {_text(pattern)}, {group})" if group else "s.value"
        return f"transform(filter({find_spans('_t', pattern)}, s -> length({value}) >= {least}), s -> named_struct('start', s.start, 'kind', {kind}, 'end', s.end))"

    # Steps of their own: an expression is resolved a level of nesting at a time, and Spark tries only so often.
    scanned = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"))
    scanned = scanned.select("doc_id", F.expr(f"sort_array(concat({', '.join(map(base, range(len(BASE))))}))").cast(struct).alias("base"), F.expr(token_parts("_t")).alias("_parts"))
    scanned = scanned.select("doc_id", "base", F.expr(chosen_tokens("_parts")).alias("found"))
    tested = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"]).alias("test")))
    scanned = scanned.select("doc_id", "base", tested.alias("tokens"))
    scanned = materialize(scanned)
    band = lambda n: F.least(F.floor(F.log2(n.cast("double"))), F.lit(MAX_BAND)).cast("int")
    flat = scanned.select(F.explode("tokens").alias("c")).select("c.test.encoding", band(F.col("c.test.n")).alias("band"), "c.test.p")
    least = F.lit(2.0)
    keep = thresholds(flat, max_false)

    def passes(c: Column) -> Column:
        at = least
        for (encoding, b), p in keep.items():
            at = F.when((c["test"]["encoding"] == encoding) & (band(c["test"]["n"]) == b), p).otherwise(at)
        return c["test"]["p"] >= at

    passed = F.transform(F.filter("tokens", passes), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    scanned = scanned.select("doc_id", "base", passed.alias("passed"))
    added = F.transform(F.expr(without("passed", "base")), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", added.cast(struct).alias("added"))


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k[0]) for k in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
