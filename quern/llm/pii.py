r"""Personal data by weak supervision, with built-in expressions only.

Base rules find e-mail and IP addresses, card and phone numbers; they always count.
Looser patterns propose further spans in English, German, French and Spanish:
national id and account numbers, secrets, phone numbers in national form, and
names. Labelers vote on every proposed span: its strict form and check digits
(regex), lists of given names, area codes and placeholders (gazetteer), the words
before it for and against (context), and other personal data close by (company).
Expectation maximisation over the counts of vote patterns, of which there is a fixed
number whatever the corpus, estimates each labeler's reliability and the chance that
a pattern is personal data; a logistic span classifier, trained on these chances,
sees besides the votes the span's length, its digits and what stands around it, and
decides which proposed spans are added.

Offsets are code points, ends exclusive. A null text is an empty one. Repeated
rows each get a row. Extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import materialize

#: Matches are the contract's; possessive forms and the look behind only keep the work linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GIVEN = (
    "Anna|Maria|John|James|Robert|Michael|William|David|Mary|Linda|Susan|Peter|Paul|Thomas|Sarah|Emma|Olivia|Daniel|Martin|Elizabeth|Jennifer|Richard|George|Alice|Henry|Lucy"
    "|Hans|Klaus|Jürgen|Wolfgang|Heike|Ursula|Sabine|Petra|Stefan|Andreas|Uwe|Greta|Lukas|Jonas|Lena|Katrin|Dieter|Günther"
    "|Jean|Pierre|Marie|François|Nathalie|Sylvie|Camille|Chloé|Luc|Michel|Philippe|Isabelle|Élodie|Mathieu|Antoine|Hélène"
    "|Carlos|Juan|José|Jose|Luis|Elena|Laura|Carmen|Pilar|Javier|Miguel|Lucía|Andrés|Sofía|Diego|Pablo|Isabel|Álvaro"
)
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Doña)\.? |(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es) "
WORD = r"\p{Lu}[\p{Ll}]{1,30}+(?:-\p{Lu}[\p{Ll}]{1,30}+)?"
LOOSE = {
    "id": r"(?<![0-9A-Za-z-])(?=[0-9]|[XYZ]|[A-Z]{2}[0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z]|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}|[1-9][0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z-])",
    "secret": r"(?:(?i)\b(?:password|passwd|passwort|kennwort|mot de passe|contraseña|token|secret|api[_-]?key) ?[=:] ?[\x22']?[A-Za-z0-9_+/!$-]{6,200}+[\x22']?)|\b(?:AKIA[0-9A-Z]{16}|gh[ps]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})\b",
    "local": r"(?<![0-9+.-])(?=[(0-9])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8}|[6789][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{3})(?![0-9.-]*[0-9])",
    # A look ahead at the first letter spares the lists at most words.
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?=[DFHMPS]|my n|ich h|mein |je m'|[IJ]|me l|mi n)(?:{TITLES})(?:{WORD})(?: {WORD})?|(?=\p{{Lu}}\p{{Ll}})(?:{GIVEN}) {WORD})",
}
BASE = ["email", "ip", "card", "phone"]
CONTEXT = {
    "id": r"(?:ssn|social|security|passport|tax|id|nif|dni|nie|iban|steuer-?id|steuernummer|identifikationsnummer|sozialversicherungsnummer|ausweis|sécu|sécurité sociale|insee|nir|identidad|cuenta|konto|account)\W{0,4}(?:no|nr|number|is|num|numéro|número|número es|lautet|est|es)?\W{0,4}$",
    "secret": r"(?:my|the|login|user|aws|access|key|with|mein|das|zugang|mon|le|accès|mi|la|clave)\W{0,4}$",
    "local": r"(?:call|phone|tel|fax|mobile|cell|dial|at|telefon|anrufen|handy|rufnummer|unter|téléphone|appelez|portable|teléfono|llame al|móvil|llamar al)\W{0,4}$",
    "name": r"(?:mr|mrs|ms|dr|name|from|by|dear|contact|signed|regards|von|liebe|lieber|gezeichnet|grüße|de|cher|chère|signé|cordialement|estimado|estimada|querido|querida|firmado|saludos|atentamente)\W{0,4}(?:is)?\W{0,4}$",
}
AGAINST = r"(?:isbn|version|page|section|figure|example|order|item|part|sku|model|lot|seite|abschnitt|beispiel|bestellung|artikel|auflage|figur|exemple|commande|article|ejemplo|página|pedido|artículo|modelo|sankt|saint|san|santa|rue|calle|avenue|straße|platz|place|plaza|ship|ms)\W{0,4}(?:no|nr|num|n°|nº)?\W{0,4}$"
NO_NAME = "Street|Road|Avenue|Day|Church|Cathedral|University|College|Hospital|Prize|Island|Museum|Platz|Kirche|Schule|Universität|Stiftung|Straße|Hospital|Rue|Église|Université|Musée|Calle|Plaza|Universidad|Iglesia|Museo"
#: Parts whose lengths are summed one after the other.
RUN = 256
MARK, OTHER = "\u0001", "\u0002"


def parts(text: Column, pattern: str) -> Column:
    """The text cut at all matches: gaps at even places, matches at odd ones. The mark's own code point is replaced by another, of no pattern's either."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK)


def running(sizes: Column) -> Column:
    """Running sums of an array. An array grows by copies, so this is for short ones."""
    return F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")) + n)))


def matches(read: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """`read`, with its text in _t, and for each name an array of (start, end, text, before) of a pattern's matches.

    Texts that fail a pattern's gate, which none with a match does, aren't searched.
    Where parts end is summed within runs of RUN parts and over the runs, so a text
    with very many matches takes no square of their number. Every step is a column
    of its own, so nothing is worked out twice.
    """
    kept = [c for c in read.columns if c != "_t"]
    cut = read.select(*kept, *[F.when(gate, parts(F.col("_t"), p)).alias(f"{k}_c") for k, (p, gate) in patterns.items()])

    def runs(k: str) -> Column:
        c = F.col(f"{k}_c")
        sizes = F.transform(c, lambda x: F.char_length(x).cast("long"))
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), lambda i: F.transform(F.slice(c, i * RUN + 1, F.lit(RUN)), lambda x: F.char_length(x).cast("long")))
        return F.when(F.size(c) == 1, F.array().cast("array<array<bigint>>")).when(F.size(c) <= RUN, F.array(sizes)).when(c.isNotNull(), many)

    def before(k: str) -> Column:
        sums = F.transform(f"{k}_r", lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, n: a + n))
        return F.when(F.size(f"{k}_r") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(F.array(F.lit(0).cast("bigint")), running(sums)))

    def each(k: str) -> Column:
        c = F.col(f"{k}_c")
        found = F.transform(F.sequence(F.lit(1), F.size(c) - 1, F.lit(2)), lambda i: F.struct((F.get(f"{k}_e", i) - F.char_length(F.get(c, i))).alias("start"), F.get(f"{k}_e", i).alias("end"), F.get(c, i).alias("text"), F.right(F.get(c, i - 1), F.lit(40)).alias("before")))
        return F.when(F.size(c) > 1, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string>>")).alias(k)

    def summed(k: str) -> Column:
        return F.flatten(F.zip_with(f"{k}_r", F.slice(f"{k}_b", F.lit(1), F.size(f"{k}_r")), lambda r, b: F.transform(running(r), lambda n: n + b)))

    names = list(patterns)
    with_runs = cut.select("*", *[runs(k).alias(f"{k}_r") for k in names])
    with_starts = with_runs.select("*", *[before(k).alias(f"{k}_b") for k in names])
    with_ends = with_starts.select("*", *[summed(k).alias(f"{k}_e") for k in names])
    return with_ends.select(*kept, *[each(k) for k in names])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.char_length(number) - i + 1, F.lit(1)).cast("int")
        d = d * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.char_length(digits(text))
        return F.when((n >= 14) & (n <= 19), luhn(digits(text))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(text)).between(10, 15)
    return F.lit(True)


def modulo(number: Column, by: int) -> Column:
    """A string of at most 18 digits modulo a small number."""
    return F.coalesce(number.try_cast("bigint"), F.lit(0)) % by


def id_fits(t: Column) -> Column:
    """1 where an id's own check holds or its form is sound, -1 where it can't be an id, 0 where nothing tells."""
    d = digits(t)
    plain = F.regexp_replace(t, "[ -]", "")
    letter = F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (modulo(F.translate(F.left(plain, F.char_length(plain) - 1), "XYZ", "012"), 23) + 1).cast("int"), F.lit(1))
    rotated = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    # Letters are two digits each; the remainder is taken piece by piece.
    rest = F.aggregate(F.split(rotated, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).when(c != "", (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))
    good = (
        F.when(t.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ~t.rlike("^(?:000|666|9..)-|-00-|-0000$"))
        .when(plain.rlike("^[0-9XYZ][0-9]{7}[A-Z]$"), F.right(plain, F.lit(1)) == letter)
        .when(plain.rlike("^[A-Z]{2}[0-9]{2}"), rest == 1)
        .when(F.char_length(d) == 15, modulo(F.right(d, F.lit(2)), 100) == 97 - modulo(F.left(d, F.lit(13)), 97))
        .when(F.char_length(d) == 11, F.size(F.array_distinct(F.split(F.left(d, F.lit(10)), ""))).isin(9, 10) | (F.size(F.array_distinct(F.split(F.left(d, F.lit(10)), ""))) == 8))
    )
    return F.when(good & (F.char_length(d) != 11), 1).when(good, 0).otherwise(-1)


def votes(kind: str, x: Column, base: str | Column) -> list[Column]:
    """A vote of each labeler on a proposed span: 1 for, -1 against, 0 none."""
    t, before = x["text"], F.lower(x["before"])
    d = digits(t)
    if kind == "id":
        strict = id_fits(t)
        listed = F.when(t.isin("123-45-6789", "078-05-1120", "12345678Z", "00000000T") | d.rlike("^(.)\\1+$"), -1).otherwise(0)
    elif kind == "secret":
        body = F.regexp_replace(t, "^[^=:]*[=:]", "")
        strict = F.when(t.rlike("AKIA[0-9A-Z]{16}|gh[ps]_|sk-") | (body.rlike("[0-9]") & body.rlike("[A-Za-z]")), 1).otherwise(-1)
        listed = F.when(F.lower(t).rlike(r"[=:] ?[\x22']?(?:password|passwort|secret|token|null|none|true|false|changeme|example|xxxx|your|dein|votre|ejemplo)"), -1).when(t.rlike("[0-9a-f]{32,}|[A-Za-z0-9+/]{24,}"), 1).otherwise(0)
    elif kind == "local":
        american = t.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}$")
        strict = F.when(american & d.rlike("^[01]|^...[01]"), -1).when(d.rlike("^(.)\\1+$|^0?123456"), -1).otherwise(1)
        listed = F.when(american & d.rlike("^(?:212|213|312|415|617|202|305|404|646|718|800|888)"), 1).when(d.rlike("^(?:030|040|089|0221|069|01[567]|0[67]|01|91[0-9]|93[0-9]|6[0-9]{2})"), 1).otherwise(0)
    else:
        bare = F.regexp_replace(t, rf"^(?:{TITLES})", "")
        strict = F.when(bare.rlike(rf"(?:^| )(?:{NO_NAME})$"), -1).when(bare.rlike(r"^\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)? \p{Lu}\p{Ll}+"), 1).otherwise(0)
        listed = F.when(bare.rlike(rf"^(?:{GIVEN})(?: |$)"), 1).otherwise(0)
    titled = t.rlike(rf"^(?:{TITLES})") if kind == "name" else F.lit(False)
    near = F.exists(base, lambda b: (b["start"] < x["end"] + 120) & (x["start"] < b["end"] + 120))
    return [strict, listed, F.when(before.rlike(CONTEXT[kind]) | titled, 1).otherwise(0), F.when(before.rlike(AGAINST), -1).otherwise(0), F.when(near, 1).otherwise(0)]


def shape_of(x: Column) -> Column:
    """What the classifier sees besides the votes: length, share of digits, and what stands before, a number below 36."""
    size = x["end"] - x["start"]
    length = F.when(size > 24, 2).when(size > 12, 1).otherwise(0)
    digit = F.when(F.char_length(digits(x["text"])) * 2 > size, 2).when(x["text"].rlike("[0-9]"), 1).otherwise(0)
    before = F.when(x["before"].rlike(r"[:=#]\s?$"), 3).when(x["before"].rlike(r"\p{Ll},?\s$"), 2).when(x["before"].rlike(r"[.!?\n]\s?$"), 1).otherwise(0)
    return length * 12 + digit * 4 + before


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, rank, end, kind) and loose (array of start, end, kind, votes, shape) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.col("_t").rlike("[0-9]")
    low = F.lower("_t")
    said = [F.contains(low, F.lit(w)) for w in ("passw", "kennwort", "mot de passe", "contrase", "token", "secret", "key")] + [F.contains("_t", F.lit(w)) for w in ("AKIA", "ghp_", "ghs_", "sk-")]
    gates = {"email": F.contains("_t", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("_t", F.lit("+")), "id": digit, "local": digit, "secret": reduce(Column.__or__, said), "name": F.col("_t").rlike(LOOSE["name"])}
    read = docs.select("doc_id", text.alias("_t"))
    found = matches(read, {k: (p, gates[k]) for k, p in {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, **LOOSE}.items()})

    # Spark counts a lambda's parameters, so what differs by kind comes in by closure, not by default values.
    def accepted(rank: int, kind: str) -> Column:
        return F.transform(F.filter(kind, lambda x: valid(kind, x["text"])), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    base = [accepted(i, k) for i, k in enumerate(BASE)]

    def proposal(kind: str, x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.array(*votes(kind, x, "base")).alias("votes"), shape_of(x).alias("shape"))

    def proposals(kind: str) -> Column:
        return F.transform(kind, lambda x: proposal(kind, x))

    with_base = found.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), *LOOSE)
    return with_base.select("doc_id", "base", F.concat(*[proposals(k) for k in LOOSE]).alias("loose"))


def reliabilities(counts: list[tuple[str, tuple[int, ...], float]], rounds: int = 40) -> dict:
    """Expectation maximisation over (kind, votes, count): a chance for each (kind, votes).

    Votes are independent given the truth; a labeler's chances of each vote depend
    on kind and truth. Starts from the majority of votes.
    """
    chance = {(k, v): 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for k, v, _ in counts}
    for _ in range(rounds):
        prior, seen = {}, {}
        for k, v, n in counts:
            p = chance[k, v]
            for truth, weight in ((1, p * n), (0, (1 - p) * n)):
                prior[k, truth] = prior.get((k, truth), 1.0) + weight
                for i, vote in enumerate(v):
                    seen[k, truth, i, vote] = seen.get((k, truth, i, vote), 0.5) + weight
        new = {}
        for k, v, _ in counts:
            logs = []
            for truth in (1, 0):
                s = math.log(prior[k, truth])
                for i, vote in enumerate(v):
                    total = sum(seen.get((k, truth, i, x), 0.5) for x in (-1, 0, 1))
                    s += math.log(seen[k, truth, i, vote] / total)
                logs.append(s)
            new[k, v] = 1 / (1 + math.exp(max(-500, min(500, logs[1] - logs[0]))))
        done = max((abs(new[x] - chance[x]) for x in new), default=0) < 1e-6
        chance = new
        if done:
            break
    return chance


def classifier(counts: list[tuple[str, tuple[int, ...], int, float]], chance: dict, rounds: int = 400) -> dict[str, float]:
    """Logistic weights, by feature name, of rows (kind, votes, shape, count) with the chances as soft labels."""
    total = sum(c for *_, c in counts) or 1.0
    rows = [(names(k, v, s), c / total, chance[k, v]) for k, v, s, c in counts]
    w: dict[str, float] = {}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for fs, c, p in rows:
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(f, 0.0) for f in fs)))))
            for f in fs:
                gradient[f] = gradient.get(f, 0.0) + c * (p - q)
        for f, g in gradient.items():
            w[f] = w.get(f, 0.0) + 2.0 * (g - 1e-4 * w.get(f, 0.0))
    return w


def names(kind: str, v: tuple[int, ...], shape: int) -> list[str]:
    return [f"{kind}", *[f"{kind}:{i}:{x}" for i, x in enumerate(v)], *[f"{kind}:{n}:{x}" for n, x in zip(("length", "digits", "before"), (shape // 12, shape // 4 % 3, shape % 4))]]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: all accepted spans (start, rank, end, kind), in order, of each row."""
    read = materialize(candidates(docs), "pii")
    # At most 4 kinds x 243 vote patterns x 36 shapes, whatever the corpus.
    counted = read.select(F.explode("loose").alias("x")).groupBy("x.kind", "x.votes", "x.shape").agg(F.count("*").alias("n")).collect()
    rows = [(r["kind"], tuple(r["votes"]), r["shape"], float(r["n"])) for r in sorted(counted, key=str)]
    chance = reliabilities([(k, v, n) for k, v, _, n in rows])
    w = classifier(rows, chance)
    accepted = [F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(x) for x in v]).alias("votes"), F.lit(s).alias("shape")) for k, v, s, _ in rows if sum(w.get(f, 0.0) for f in names(k, v, s)) >= 0]
    added = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    if accepted:
        allowed = F.array(*accepted)
        rank = lambda x: (F.array_position(F.array(*[F.lit(k) for k in LOOSE]), x["kind"]) + len(BASE) - 1).cast("int")
        fits = F.filter("loose", lambda x: F.array_contains(allowed, F.struct(x["kind"].alias("kind"), x["votes"].alias("votes"), x["shape"].alias("shape"))))
        # What a base span already covers isn't added.
        fresh = F.filter(fits, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        added = F.transform(fresh, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return read.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """`docs` with the base kinds' matches replaced by <KIND>, for texts in use."""

    def without(text: Column, kind: str, pattern: str) -> Column:
        instead = F.lit((kinds or {}).get(kind, f"<{kind.upper()}>"))
        return F.array_join(F.transform(parts(text, pattern), lambda x, i: F.when((i % 2 == 1) & valid(kind, x), instead).otherwise(x)), "")

    text = F.coalesce(F.col("text"), F.lit(""))
    for kind, pattern in {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.items():
        text = without(text, kind, pattern)
    return docs.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(text))
