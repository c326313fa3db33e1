"""Secret scan: candidates by their form, false positives removed by a random forest trained on labelled findings.

Candidates are read from left to right, each with its position: what is assigned to a name that announces a secret: in quotes
(`password = "..."`) all up to the same quote in the line, 8 characters or more, spaces and brackets too; without (`token: ...`)
8 characters or more of any kind up to a space, quote, comma, semicolon or bracket; a password
inside a URL (`//user:...@`); three runs of 16 or more letters, digits and `_ -` with dots between them, as web tokens have, as one; and
runs of 16 or more letters, digits and `+ / _ -` (and `=` at the end) that no letter or digit adjoins.

The forest's features are the length, the shares of digits, capitals and symbols, the changes between kinds of characters, the transitions
from each character to the next (the mean of their log ratios between secrets and others, a table learned from the labelled
findings), the variety of characters, the share covered by a dictionary of frequent words and syllables, signs of a path, and
the words, quote and assignment around the occurrence. Every occurrence is described; the likeliest counts. Table and
forest are fitted on labelled findings, by default those made by the rules in `labelled_findings`.

One row for each document and candidate that the forest takes for a secret, with its first position (from 1) and number of
occurrences, not counting those inside longer runs. Null and empty texts have none. Rows that repeat an id are scanned each; a null id is kept.
Equal rows are told apart by a row number, so the rows must come in the same order when a task is repeated, as those of a scan do.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names to which secrets are assigned.
ASSIGNED = "passw(?:or)?d passwd passphrase pwd secret token api[_-]?key apikey access[_-]?key private[_-]?key credentials?"
_NAME = "(?i:" + "|".join(ASSIGNED.split()) + ")"
_SET = r"[\"'`]?[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3}"
# the first look at one character spares the longer ones at most places
CANDIDATE = (
    r"(?<=[\"'`])(?:" + "|".join(f"(?<={_NAME}{_SET}{q})[^{q}\\s][^{q}\\r\\n]{{7,}}+(?<!\\s)(?={q})" for q in "\"'`") + ")"
    r"|(?<=[=:> \t\"'`])(?<=[=:]>?[ \t]{0,3}[\"'`]?)(?<=" + _NAME + _SET + r"[\"'`]?)[^\s\"'`,;<>(){}\[\]]{7,}[^\s\"'`,;<>(){}\[\].:!?]"
    r"|(?<=:)(?<=//[^\s:/@]{1,40}:)[^\s:/@]{6,}(?=@)"
    r"|(?<![\p{L}\p{N}+/_\-])[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+\.[A-Za-z0-9_\-]{16,}+(?!\.?[\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}+(?![\p{L}\p{N}])"
)
AROUND = 40
TREES, DEPTH, FINDINGS = 40, 8, 3000
# Frequent words and syllables of running text and identifiers.
FREQUENT = (
    "the and that with from this have not are was for ing tion ent ion est ate ter ous ess ive ment able ness ship ther here com con pro pre inter over under der die das und ein sch ung keit heit lich ber ver ich "
    "les des que ent oux eux elle aux eau pour par los las del cion mente ado con para get set is has new old user name file path data value type test index list item node main page view model class string number config error "
    "handler service manager factory default build common utils module package version release update request response client server http www html json org net src lib bin usr home var tmp opt etc docs static assets images public"
).split()
# Words that announce a secret, and words that announce something else of that form.
ANNOUNCE = "token secret passw pwd passphrase api[_-]?key apikey access[_-]?key auth bearer credential private client_?id signature session //[^\\s:/@]+:$"
OTHERWISE = "commit sha-?1 sha-?256 md5 checksum hash digest revision uuid guid isbn serial order invoice phone card iban version example"
# Words of sentences and forms, which phrases made of chosen words seldom have.
SPOKEN = "a an and are as at be by can click do does enter field for from here if in is it leave must need new no not of on or password please provide required set should that the this to type use user was when will with you your".split()
FEATURES = ["length", "digits", "capitals", "symbols", "changes", "transitions", "variety", "frequent", "vowels", "slashes", "separators", "announced", "otherwise", "assigned", "quoted", "hexadecimal", "number", "spaces", "dots", "spoken"]
# Characters as the table of transitions sees them: letters without case, any digit, anything else.
KINDS = 28


def transition_table(findings: list[tuple[str, str, str, float]]) -> list[float]:
    """For each two kinds of characters, the logarithm of how much more often they follow each other in secrets than in other findings."""
    seen = (Counter(), Counter())
    for finding, _, _, label in findings:
        kinds = [26 if "0" <= c <= "9" else ord(c.lower()) - 97 if c.isascii() and c.isalpha() else 27 for c in finding]
        seen[int(label)].update(a * KINDS + b for a, b in zip(kinds, kinds[1:], strict=False))
    total = [sum(c.values()) + KINDS * KINDS for c in seen]
    return [math.log((seen[1][i] + 1) / total[1]) - math.log((seen[0][i] + 1) / total[0]) for i in range(KINDS * KINDS)]


def described(rows: DataFrame, transitions: list[float] | None = None) -> DataFrame:
    """Adds the features; rows: finding, before, after. transitions: a table of `transition_table`."""
    c = F.col("finding")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), r"[^aB0]", "-")
    words = "(?i)(" + "|".join(sorted(FREQUENT, key=lambda w: (-len(w), w))) + ")"
    before = F.coalesce("before", F.lit(""))
    named = lambda words: F.regexp_like(before, F.lit("(?i)(" + "|".join(words.split()) + ")")).cast("double")
    table = F.lit(list(transitions or standard_transitions()))
    # letters are 97 to 122, digits then 123 and all else 124; within a lambda the codes are a value, outside they would be made anew for each pair
    plain = F.regexp_replace(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[0-9]", "{"), "[^a-z{]", "|")
    codes = F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.ascii(x) - 97)
    pair = lambda a, i: F.get(table, F.get(a, i) * KINDS + F.get(a, i + 1))
    along = F.transform(F.array(codes), lambda a: F.aggregate(F.sequence(F.lit(0), F.size(a) - 2), F.lit(0.0), lambda t, i: t + pair(a, i)))
    return rows.withColumns(
        {
            "length": n,
            "digits": share("[0-9]"),
            "capitals": share("[A-Z]"),
            "symbols": share("[^A-Za-z0-9]"),
            "changes": (F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) - 1) / n,
            "transitions": F.when(n > 1, F.get(along, F.lit(0)) / (n - 1)).otherwise(0.0),
            "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(36.0)),
            "frequent": 1 - F.length(F.regexp_replace(c, words, "")) / n,
            "vowels": share("(?i)[aeiou]"),
            "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
            "separators": F.regexp_count(c, F.lit("[_-]")).cast("double"),
            "announced": named(ANNOUNCE),
            "otherwise": named(OTHERWISE),
            "assigned": F.regexp_like(before, F.lit(r"[=:]\s*[\"'`]?$")).cast("double"),
            "quoted": (F.regexp_like(before, F.lit("[\"'`]$")) & F.regexp_like(F.coalesce("after", F.lit("")), F.lit("^[\"'`]"))).cast("double"),
            "hexadecimal": F.regexp_like(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$")).cast("double"),
            "number": F.regexp_like(c, F.lit("^[0-9_-]+$")).cast("double"),
            "spaces": F.regexp_count(c, F.lit(r"\s")).cast("double"),
            "dots": F.regexp_count(c, F.lit("[.]")).cast("double"),
            "spoken": F.regexp_count(c, F.lit(r"(?i)(?<!\p{L})(" + "|".join(SPOKEN) + r")(?!\p{L})")) / (F.regexp_count(c, F.lit(r"\s")) + 1),
        }
    )


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, float]]:
    """(finding, text before, text after, 1.0 for a secret), made by rules; the same for equal arguments."""
    r = random.Random(seed)
    hexa, lower, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    syllables = ["th", "er", "an", "in", "on", "ed", "es", "st", "re", "tion", "ing", "ble", "ou", "ha", "ch", "en", "sch", "ung", "te", "la", "ra", "do", "ci", "men", "eau", "lle", "mo", "ka", "pre", "con", "wer"]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    spelt = lambda k: "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", *"lmnrst"]) for _ in range(k))
    either = lambda k: word(k) if r.random() < 0.4 else spelt(k)
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credentials", "Bearer", "session_key", "signature"]
    others = ["commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "revision", "uuid", "order", "invoice", "card", "version"]
    out = []
    for i in range(n):
        kind = r.random()
        if i % 10 == 7:  # passwords
            s = r.choice([some(mixed + "!#$%&*+-.?@^_~", r.randrange(8, 18)), word(2).capitalize() + some("0123456789", r.randrange(2, 5)) + r.choice(["", *"!#$&@?"]), word(2).replace("o", "0").replace("e", "3").replace("i", "1") + some("0123456789!$&", 3), some(lower, 4) + some("0123456789", 5)])
            s = s if len(s) >= 8 else s + some(lower + "0123456789", 8 - len(s))
            phrase = r.random() < 0.35  # of some words
            s = r.choice([" ", " ", "-"]).join(either(r.randrange(1, 4)) for _ in range(r.randrange(3, 7))) + r.choice(["", "", "7", "!"]) if phrase else s
            name = r.choice(["password", "passwd", "pwd", "db_password", "passphrase", "secret", "token"])
            before, after = r.choice([(f'{name} = "', '"'), (f"{name}: ", " "), (f"{name}=", " "), (f"{word(2)} {name}: ", "."), (f"https://{word(1)}:", "@")][: 1 if phrase else 5])
            out.append((s, before, after, 1.0))
        elif i % 10 == 8:  # words and paths where a secret might stand
            s = r.choice([word(r.randrange(3, 6)), word(2) + r.choice(["_", "-", "."]) + word(2), "/".join(["", word(1), word(2), word(1)]), f"https://{word(2)}.{word(1)}/{word(1)}", word(4).capitalize(), word(2) + word(2).capitalize(), r.choice(["required", "disabled", "undefined", "available", "everything", "somewhere", "null|undefined", "********", "xxxxxxxxxx", "<redacted>", "...........x"])])
            s = s if len(s) >= 8 else s + word(4)
            if r.random() < 0.35:  # what a form says
                s = " ".join(r.choice(SPOKEN) if r.random() < 0.55 else either(r.randrange(1, 4)) for _ in range(r.randrange(3, 9)))
                s = s if len(s) >= 8 else s + " " + word(4)
                out.append((s, r.choice(['password = "', 'password: "', 'token="', '"secret": "']), '"', 0.0))
                continue
            name = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "credentials"])
            out.append((s, r.choice([f"the {name}: ", f"{name}: ", f"{name} = ", f'{name}="', f"{word(2)} {name}: "]), r.choice([" ", ".", ",", '"']), 0.0))
        elif i % 20 == 5:  # web tokens
            s = ".".join(some(mixed + "-_", r.randrange(18, 90)) for _ in range(3))
            out.append((s, r.choice(['token = "', "Bearer ", f"{word(2)} ", "jwt: "]), r.choice(['"', " ", ""]), 1.0))
        elif i % 20 == 4:  # long names with dots
            s = ".".join(r.choice(["", "_", "-"]).join(word(r.randrange(3, 6)) for _ in range(3)) + word(8) for _ in range(3))
            out.append((s, f"{word(2)} ", r.choice([" ", ""]), 0.0))
        elif i % 2:
            s = some(hexa, r.choice([24, 32, 40, 40, 48, 64])) if kind < 0.45 else some(mixed, r.choice([20, 24, 32, 40, 43, 64])) if kind < 0.7 else some(mixed + "+/", r.choice([40, 44, 86])) if kind < 0.8 else r.choice(["AKIA", "ghp_", "sk_live_", "glpat-", "xoxb-", "AIza"]) + some(mixed, r.choice([16, 24, 36])) if kind < 0.95 else some(lower + "0123456789", r.choice([20, 32]))
            if r.random() < 0.12:
                s = s.upper()
            name = r.choice(names)
            before = r.choice([f'{name} = "', f"{name}: ", f"{name}=", f'"{name}": "', f"{name} ", f'{name.upper()} = "', f'{word(2)} {name} = "', f"{word(3)} "])
            after = '"' if before.endswith('"') else r.choice([" ", ".", ""])
            out.append((s, before, after, 1.0))
        else:
            before, after = f"{word(2)} {word(1)} ", r.choice([" ", ",", ".", ""])
            if kind < 0.35:
                s = word(9)
                s = s.upper() if r.random() < 0.2 else s.capitalize() if r.random() < 0.2 else s
            elif kind < 0.45:
                s = some("0123456789", r.choice([16, 16, 18, 20]))
            elif kind < 0.57:
                s = "/".join(word(r.randrange(1, 4)) for _ in range(r.randrange(3, 7)))
            elif kind < 0.69:
                s = r.choice(["_", "-"]).join(word(r.randrange(1, 4)) for _ in range(r.randrange(3, 7)))
            elif kind < 0.77:
                s = "".join(word(2).capitalize() for _ in range(r.randrange(3, 6)))
            elif kind < 0.82:
                s = r.choice("-_+xX0*a").replace("*", "-") * r.randrange(16, 40)
            elif kind < 0.92:
                s, before = some(hexa, r.choice([32, 40, 64])), f"{r.choice(others)}{r.choice([' ', ': ', '='])}"
            elif kind < 0.96:
                s = "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
            else:
                s, before, after = word(8), f'{r.choice(names)} = "', '"'
            s = s if len(s) >= 16 else s + word(8)
            out.append((s, before, after, 0.0))
    return out


@functools.cache
def standard_transitions() -> tuple[float, ...]:
    return tuple(transition_table(labelled_findings()))


def forest(spark: SparkSession, findings: list[tuple[str, str, str, float]] | None = None) -> RandomForestClassificationModel:
    rows = spark.createDataFrame(findings or labelled_findings(), "finding string, before string, after string, label double").coalesce(2)
    rows = described(rows, transition_table(findings) if findings else None)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, subsamplingRate=0.8, seed=7, cacheNodeIds=False).fit(rows.select("features", "label"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, finding, start, n_occurrences, before, after): one row per row of docs, distinct candidate in it and distinct surroundings of that."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    # what stands before, between and after the candidates; as values of a lambda both lists are made once
    parts = F.array(F.struct(F.split("text", CANDIDATE, -1).alias("p"), found.alias("c")))
    sizes = "transform(x.c, (c, i) -> length(c) + length(x.p[i]))"
    # sums over groups of 256 come first, so that a position takes few steps in texts of many candidates
    groups = "transform(sequence(0, size(x.c) div 256), g -> aggregate(slice(x.n, 256 * g + 1, 256), 0, (t, n) -> t + n))"
    start = "aggregate(slice(x.g, 1, i div 256), 0, (t, n) -> t + n) + aggregate(slice(x.n, 256 * (i div 256) + 1, i % 256), 0, (t, n) -> t + n) + length(x.p[i]) + 1"
    before = f"if(i > 0 and length(x.p[i]) < {AROUND}, right(concat(right(x.p[i - 1], {AROUND}), x.c[i - 1], x.p[i]), {AROUND}), right(x.p[i], {AROUND}))"
    rows = rows.where(F.regexp_like("text", F.lit(CANDIDATE))).withColumn("parts", parts)
    sized = f"transform(parts, x -> named_struct('p', x.p, 'c', x.c, 'n', {sizes}))"
    grouped = f"transform({sized}, x -> named_struct('p', x.p, 'c', x.c, 'n', x.n, 'g', {groups}))"
    all_of = f"transform({grouped}, x -> transform(x.c, (c, i) -> named_struct('finding', c, 'start', {start}, 'before', {before}, 'after', left(concat(x.p[i + 1], coalesce(get(x.c, i + 1), '')), 1))))"
    rows = rows.select("doc_id", "row", F.inline(F.expr(f"flatten({all_of})")))
    places = F.collect_set(F.struct("before", "after")).alias("places")
    rows = rows.groupBy("doc_id", "row", "finding").agg(F.min("start").cast("int").alias("start"), F.count(F.lit(1)).cast("int").alias("n_occurrences"), places)
    return rows.select("doc_id", "row", "finding", "start", "n_occurrences", F.inline("places"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, findings: list[tuple[str, str, str, float]] | None = None) -> DataFrame:
    """(doc_id, finding, start, n_occurrences, score) of what the forest takes for secrets at one of its places; findings: labelled ones to learn from."""
    found = described(candidates(docs, id_col, text_col), transition_table(findings) if findings else None)
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = forest(docs.sparkSession, findings).transform(found).withColumn("score", F.get(vector_to_array("probability"), 1))
    scored = scored.where(F.col("score") >= least).groupBy("row", "doc_id", "finding", "start", "n_occurrences").agg(F.max("score").alias("score"))
    return scored.select("doc_id", "finding", "start", "n_occurrences", F.round("score", 6).alias("score"))
