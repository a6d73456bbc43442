"""Column expressions over text and numbers."""
from pyspark.sql import functions as F


def clean(c):
    """Lower case; addresses, mentions and all but letters become spaces; hashtags keep their word."""
    c = F.regexp_replace(F.lower(c), r"http\S+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"@[\p{L}\p{N}_]+", " "), r"#([\p{L}\p{N}_]+)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\s]", " "), r"\s+", " "))


def tokens(c, least=3):
    return F.filter(F.split(clean(c), " "), lambda t: F.length(t) >= least)


def content_id(c):
    return F.substring(F.sha1(c), 1, 16)


def truncate_words(c, n):
    """At most n characters, cut at the last space inside them unless that is the first character, without white space at the end, and an ellipsis."""
    head = F.substring(c, 1, n)
    at = F.when(F.locate(" ", F.reverse(head)) > 0, F.length(head) - F.locate(" ", F.reverse(head))).otherwise(F.lit(0))
    cut = F.when(at > 0, head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("…")))


def truncate_hard(c, n):
    """At most n characters, the last of them an ellipsis if any was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def snippet(c, n=160):
    """One table cell: no pipes or line breaks, at most n characters."""
    return F.substring(F.regexp_replace(c, r"[|\r\n]", " "), 1, n)


def defuse(c, wide=True):
    """Angle brackets as look-alikes that are no markup: full-width ones or guillemets."""
    return F.translate(c, "<>", "＜＞" if wide else "‹›")


def single_line(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sanitise(c):
    """Without control characters but line feeds and tabs."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")


def slug(c):
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40)
    return F.when(s == "", "query").otherwise(s)


def heading_slug(c):
    """Lower case, without marks but hyphens, each space a hyphen."""
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_ -]", ""), F.lit(" "), F.lit("-"))


#: A handle in brackets, alone or followed by a comma and a post's id, before which `id` may stand.
CITED = r"(?i)\[(E[0-9]+) *(?:, *(?:id +)?([\w-]+))?\]"


def citations(c):
    """Array of (handle, id or empty) of each citation [E1] or [E1, id x]."""
    return F.zip_with(F.regexp_extract_all(c, F.lit(CITED), F.lit(1)), F.regexp_extract_all(c, F.lit(CITED), F.lit(2)), lambda h, i: F.struct(F.upper(h).alias("handle"), i.alias("id")))


#: Words of an answer that declines to give a label.
REFUSALS = ["n/a", "na", "insufficient", "unable to", "cannot determine", "not enough data", "not enough information", "unclear"]
REFUSALS += [f"no {a}{b}" for a in ("", "clear ", "sufficient ") for b in ("topic", "data", "information")]


def label_of(c):
    """What follows the first `topic:` on its line, without quotes around it; null without it, for nothing, for over eight words, and where it holds a refusal's words, whole and in any case."""
    line = F.trim(F.regexp_replace(F.regexp_extract(c, r"(?i)topic:\s*([^\n]+)", 1), r"^[\s\"']+|[\s\"']+$", ""))
    bad = (line == "") | (F.size(F.split(line, r"\s+")) > 8) | line.rlike(r"(?i)\b(" + "|".join(REFUSALS) + r")\b")
    return F.when(~bad, line)


def outer_json(c):
    """The outermost {...} of a text, code fences or not; null if there is none."""
    s = F.regexp_extract(F.regexp_replace(c, r"```[a-zA-Z]*", ""), r"(?s)\{.*\}", 0)
    return F.when(s != "", s)


def sub_questions(answer, question):
    """The array `sub_queries` of an answer's JSON; the question alone if it can't be read or is empty."""
    got = F.from_json(outer_json(answer), "sub_queries array<string>")["sub_queries"]
    got = F.filter(F.transform(got, lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    return F.when(F.size(got) > 0, got).otherwise(F.array(question))


def cache_key(model, c):
    """Key of a text's embedding by a model."""
    return F.substring(F.sha2(F.concat(F.lit(f"{model}:"), c), 256), 1, 16)


def instruct(prompt, c):
    return F.concat(F.lit(f"Instruct: {prompt}\nQuery:"), c)


def parse_time(c):
    """A timestamp from a number of seconds or from text in ISO form, with or without offset, or as day and time apart; null if none fits. The session's time zone should be UTC."""
    s = c.cast("string")
    seconds = s.try_cast("double")
    tries = [F.try_to_timestamp(F.regexp_replace(s, "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in ("yyyy/MM/dd HH:mm", "MM/dd/yyyy", "dd MMM yyyy HH:mm:ss Z")]
    return F.coalesce(F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)), s.try_cast("timestamp"), *tries)


def iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number(c, default=0.0):
    """A finite double, or the default."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(default))).otherwise(x)


def cluster_name(c):
    return F.when(c >= 0, F.format_string("cluster_%04d", c))


def norm(v):
    return F.sqrt(dot(v, v))


def cosine(a, b):
    return dot(a, b) / (norm(a) * norm(b))


def scaled(v, least):
    """A vector over its norm; over `least` if the norm is smaller."""
    n = F.greatest(norm(v), F.lit(float(least)))
    return F.transform(v, lambda x: x.cast("double") / n)


def truncated(v, dim):
    """The first dim entries at norm 1."""
    return scaled(F.slice(v, 1, dim), 1e-10)


def unit(v):
    """At norm 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def node_size(engagement, largest, mult=1.0, scale=1.0):
    return 2.5 * (0.6 + 0.4 * F.sqrt(1 + engagement / largest)) * mult * scale


def plain(c):
    """Lower case without accents of Latin letters."""
    return F.translate(F.lower(c), ACCENTED, BARE)


#: Accented Latin letters and what they are without.
ACCENTED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Upper bounds of engagement tiers 1 to 5 on (1, 10], and the tiers' quotas out and in.
RATIOS, OUT, IN = (0.236, 0.382, 0.5, 0.618, 0.786), (1, 2, 3, 4, 5, 5), (1, 1, 1, 1, 3, 0)


def tier(c):
    out = F.lit(6)
    for i, r in reversed(list(enumerate(RATIOS))):
        out = F.when(c < 1 + 9 * r, i + 1).otherwise(out)
    return out
