"""Variant spellings of the names of persons and organisations, attributed to one by a noisy channel."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.operators.multivalue import ORG_TYPES, split_authors
from foliant.operators.skew import salted_join
from foliant.session import cut

# Short forms of given names and the names they may stand for
NICKNAMES = {
    "al": "albert", "alf": "alfred", "andy": "andrew", "art": "arthur", "becky": "rebecca", "ben": "benjamin", "bert": "albert bertha", "bertie": "albert bertha",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher",
    "cy": "cyrus", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "dolly": "dorothy", "dot": "dorothy", "doug": "douglas", "ed": "edward edgar",
    "eddie": "edward edgar", "ellie": "eleanor", "ernie": "ernest", "frank": "francis", "fran": "francis", "fred": "frederick", "gert": "gertrude", "gerty": "gertrude",
    "ginny": "virginia", "greg": "gregory", "hal": "harold henry", "hank": "henry", "harry": "henry harold", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph",
    "judy": "judith", "kate": "catherine katrin", "kathy": "catherine", "ken": "kenneth", "kit": "christopher", "larry": "lawrence", "laurie": "lawrence", "len": "leonard",
    "liz": "elizabeth", "lou": "louisa", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael", "millie": "amelia", "nan": "hannah", "nat": "nathan",
    "nate": "nathan", "ned": "edward edgar", "nell": "eleanor helen", "nick": "nicholas", "ollie": "olive oliver", "ozzie": "oswald", "pat": "patrick", "paddy": "patrick",
    "peggy": "margaret", "pete": "peter", "phil": "philip", "prissy": "priscilla", "ray": "raymond", "rob": "robert", "sally": "sarah", "sam": "samuel", "sue": "susan",
    "susie": "susan", "ted": "edward theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vic": "victor", "vince": "vincent",
    "walt": "walter", "wes": "wesley", "will": "william", "winnie": "winifred",
}
# Short forms of the kinds of organisation
ORG_SHORT = {"dept": "department", "inst": "institute", "assoc": "association", "comm": "commission", "bur": "bureau", "soc": "society", "univ": "university", "lab": "laboratory", "acad": "academy", "fed": "federation", "center": "centre", "co": "company", "found": "foundation"}
_ORG_TYPES = frozenset(ORG_TYPES)
_WORDS = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*")
_SUR = re.compile(r"[A-Za-z'-]+")
_ORG_STOP = {"the", "of", "for", "and", "on", "in", "at"}
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "rev", "jr", "sr", "phd", "md"}


def fold(text: str) -> str:
    """Without accents."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def parse_name(text: str) -> tuple[str, str, list[str]] | None:
    """('person', surname, given names or initials) or ('org', '', content words), in lower case without accents."""
    t = fold(text)
    words = _WORDS.findall(t)
    low = [w.lower() for w in words]
    if len(words) > 2 and not _ORG_TYPES.isdisjoint(low):
        return "org", "", [ORG_SHORT.get(w, w) for w in low if w not in _ORG_STOP]
    if "," in t:
        left, right = t.split(",", 1)
        sur = [w for w in _SUR.findall(left) if w.lower().strip(".") not in _TITLES]
        given = _WORDS.findall(right)
        surname = "".join(sur).lower()
    else:
        lead = 0
        while lead < len(words) and words[lead].lower() in _TITLES:
            lead += 1
        body = words[lead:]
        if not body:
            return None
        mixed = any(not w.isupper() for w in body)
        k = len(body)
        while k > 1 and (len(body[k - 1]) == 1 or (mixed and body[k - 1].isupper() and len(body[k - 1]) <= 3)):
            k -= 1
        if k < len(body) and len(body[0]) > 1:
            surname, given = "".join(body[:k]).lower(), body[k:]
        else:
            surname, given = body[-1].lower(), body[:-1]
    out: list[str] = []
    for k, g in enumerate(given):
        g0 = g.lower()
        if g0 in _TITLES and not (g.isupper() and len(g) <= 2) and k == len(given) - 1 and k:
            continue
        out += list(g0) if g.isupper() and len(g) <= 3 else [g0]
    surname = surname.replace("'", "").replace("-", "")
    return ("person", surname, out) if surname else None


def _spread(names: DataFrame) -> DataFrame:
    """The spellings of (id, issn, field, many, t, p): (id, issn, t, p, kind, sur, given), parsed in Python batch-wise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}

        def parsed(field: str, many: bool) -> list[tuple[str, str, str]]:
            got = [parse_name(v) for v in (split_authors(field) if many else [field])]
            return [(p[0], p[1], " ".join(p[2])) for p in got if p]

        for b in batches:
            rows = []
            for i, issn, t, p, field, many in zip(b["id"], b["issn"], b["t"], b["p"], b["field"], b["many"]):
                if field not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[field] = parsed(field, many)
                for kind, sur, given in cache[field]:
                    rows.append((i, issn, t, p, kind, sur, given))
            yield pd.DataFrame(rows, columns=["id", "issn", "t", "p", "kind", "sur", "given"])

    return names.where("id IS NOT NULL AND issn IS NOT NULL AND field IS NOT NULL").mapInPandas(run, "id long, issn string, t long, p long, kind string, sur string, given string")


ERROR_RATE = 0.05  # of typing a word with one error
NEW_NAME = 1 / 15  # per letter: how likely a name never seen is spelled just so
LONGEST_WORD = 64  # letters; anything longer is no typed name and stands for itself
REPEAT = 0.05  # how likely the same error is made once more, beyond what is expected
SHARE = 0.05  # of a name's typings, what one error may make up without being unexpected


def attribute(words: DataFrame) -> DataFrame:
    """(scope, word, canon): every spelling of (scope, word, n) with the spelling it stands for. A column ``typings`` says how
    many of the n were typed independently of each other; without it all were.

    Candidates are the more frequent spellings of the scope at one insertion, deletion, substitution or exchange of
    neighbours; they meet through shared deletions of one letter, so a key brings together at most 26 * (length + 1) + 1
    words. Each candidate's log posterior is the log of its frequency beside the word's plus the log likelihood of the
    error, once for the first typing and REPEAT for every other beyond the share SHARE of the candidate's typings, so that
    an error of a frequent name stays one however large the table; it competes with the word being a name of its own. The
    best wins, ties by frequency, then alphabet. An attributed word's own canonical form is followed once more.
    """
    gone = F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))))
    typings = F.col("typings" if "typings" in words.columns else "n").alias("typings")
    keyed = words.where(f"length(word) BETWEEN 3 AND {LONGEST_WORD}").select("scope", "word", "n", typings, F.explode(gone).alias("part"))
    v, c = keyed.alias("v"), keyed.alias("c")
    more = (F.col("c.n") > F.col("v.n")) | ((F.col("c.n") == F.col("v.n")) & (F.col("c.word") < F.col("v.word")))
    pairs = v.join(c, (F.col("v.scope") == F.col("c.scope")) & (F.col("v.part") == F.col("c.part")) & more).select(
        F.col("v.scope").alias("scope"), F.col("v.word").alias("word"), F.col("v.n").alias("n"), F.col("c.word").alias("canon"), F.col("c.n").alias("m"),
        F.greatest(F.col("v.typings") - 1 - SHARE * F.col("c.typings"), F.lit(0.0)).alias("repeats"),
    )
    steps = F.levenshtein("word", "canon")
    swap = (steps == 2) & (F.length("word") == F.length("canon")) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("canon", "")))
    error = F.when(steps == 1, F.log(F.lit(ERROR_RATE) / (54.0 * F.length("canon")))).when(swap, F.log(F.lit(ERROR_RATE) / (4.0 * F.length("canon"))))
    typed = F.log(F.col("m") / F.col("n")) + error + F.col("repeats") * math.log(REPEAT)
    own = F.length("word") * math.log(NEW_NAME)
    best = (
        pairs.where(error.isNotNull() & (typed > own))
        .groupBy("scope", "word")
        .agg(F.max_by("canon", F.struct(typed.alias("p"), F.col("m"), F.col("canon"))).alias("canon"))
    )
    again = best.select("scope", F.col("word").alias("canon"), F.col("canon").alias("next"))
    return best.join(again, ["scope", "canon"], "left").select("scope", "word", F.coalesce("next", "canon").alias("canon"))


def _nick(c: str):
    """The full names a given name may stand for: those of a short form, else itself."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))]), F.col(c)), F.array(c))


def resolve(parsed: DataFrame) -> DataFrame:
    """Spellings (issn, kind, sur, given) with their canonical key: (…, n, who, first, full, second).

    ``who`` is the surname or the sorted words of the organisation after attribution, ``first`` the given name or initial
    after attribution, ``full`` the full given names it may stand for (empty for an initial), ``second`` the next given
    name or initial.
    """
    forms = parsed.groupBy("issn", "kind", "sur", "given").agg(F.count(F.lit(1)).alias("n"))
    forms = cut(forms, "forms")
    person, org = forms.where("kind = 'person'"), forms.where("kind = 'org'")
    g = F.split("given", " ")
    words = (
        person.select(F.concat(F.lit("S"), "issn").alias("scope"), F.col("sur").alias("word"), "n")
        .unionByName(person.select(F.lit("G").alias("scope"), F.explode(g).alias("word"), "n").where("length(word) > 1"))
        .unionByName(org.select(F.concat(F.lit("O"), "issn").alias("scope"), F.explode(g).alias("word"), "n"))
        .groupBy("scope", "word")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("typings"))  # a form that comes again is copied, not typed again
    )
    fixed = cut(attribute(words), "attributed")
    sur = fixed.where("scope LIKE 'S%'").select(F.substring("scope", 2, 100).alias("issn"), F.col("word").alias("sur"), F.col("canon").alias("sur_c"))
    giv = fixed.where("scope = 'G'").select("word", "canon")
    p = person.join(sur, ["issn", "sur"], "left").withColumn("who", F.coalesce("sur_c", "sur")).withColumn("g1", F.get(g, F.lit(0))).withColumn("g2", F.coalesce(F.get(g, F.lit(1)), F.lit("")))
    p = p.join(giv.toDF("g1", "c1"), "g1", "left").join(giv.toDF("g2", "c2"), "g2", "left")
    p = p.withColumn("first", F.coalesce("c1", "g1")).withColumn("second", F.coalesce("c2", "g2"))
    p = p.withColumn("full", F.when(F.length("first") > 1, _nick("first")).otherwise(F.array().cast("array<string>")))
    p = p.select("issn", "kind", "sur", "given", "n", "who", "first", "full", "second")
    o = org.select("issn", "kind", "sur", "given", "n", F.explode(g).alias("word"))
    ofix = fixed.where("scope LIKE 'O%'").select(F.substring("scope", 2, 100).alias("issn"), "word", "canon")
    o = o.join(ofix, ["issn", "word"], "left").groupBy("issn", "kind", "sur", "given", "n").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("canon", "word"))), " ").alias("who"))
    o = o.select("issn", "kind", "sur", "given", "n", "who", F.lit("").alias("first"), F.array().cast("array<string>").alias("full"), F.lit("").alias("second"))
    return cut(p.unionByName(o), "resolved")


def _fits(full: Column, first: Column, second: Column, person: Column) -> Column:
    """Whether a form may be short for a person (given, mid): nothing in it contradicts."""
    given = F.when(F.size(full) > 0, F.array_contains(full, person["given"])).otherwise(F.substring(person["given"], 1, 1) == first)
    mid = (second == "") | (person["mid"] == "") | (F.substring(second, 1, 1) == person["mid"])
    return given & mid


def doubtful_forms(forms: DataFrame) -> DataFrame:
    """(issn, kind, sur, given, who, second, persons, open): the forms of persons in surnames where it can be doubtful who
    is meant.

    Persons of a journal and surname are the pairs of a full given name and a middle initial ('' if none) that were typed
    there; ``persons`` are those (given, mid) that the form fits. It is ``open`` if these contradict each other: an initial
    before two given names, a nickname of two, a name without its middle initial.
    """
    one = F.size("full") == 1
    person = F.struct(F.col("full")[0].alias("given"), F.substring("second", 1, 1).alias("mid"))
    several = forms.where("kind = 'person'").groupBy("issn", "who").agg(F.collect_set(F.when(one, person)).alias("all"), F.max(F.size("full") > 1).alias("nick"))
    pick = lambda f: F.size(F.array_distinct(F.transform("all", f)))
    middle = F.filter("all", lambda x: x["mid"] != "")
    several = several.where(
        (pick(lambda x: F.substring(x["given"], 1, 1)) < pick(lambda x: x["given"]))  # two names behind an initial,
        | (F.size(middle) > F.size(F.array_distinct(F.transform(middle, lambda x: x["given"]))))  # two middle initials of a name,
        | (F.col("nick") & (F.size("all") > 1))  # or of a nickname
    ).drop("nick")
    there = forms.where("kind = 'person'").join(several, ["issn", "who"])
    there = there.withColumn("persons", F.filter("all", lambda x: _fits(F.col("full"), F.col("first"), F.col("second"), x)))
    mids = F.array_distinct(F.filter(F.transform("persons", lambda x: x["mid"]), lambda x: x != ""))
    names = F.array_distinct(F.transform("persons", lambda x: x["given"]))
    there = there.withColumn("open", (F.size(names) > 1) | (F.size(mids) > 1))
    return cut(there.where("open OR size(full) = 1").select("issn", "kind", "sur", "given", "who", "full", "second", "persons", "open"), "doubtful")


DROPPED = 0.4  # how often a middle name is left out
UNSEEN = 0.05  # how likely a middle initial is of a person who was never written with one
ARTICLE = 50.0  # what a form in the same article weighs beside one elsewhere in the journal


def settle_forms(mentions: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(id, toc, issn, kind, who, name, mid): for each mention of an open form the person of maximum posterior.

    The prior is how often a person is written in the journal, in distinct articles, and ARTICLE times that for the same
    article (its title ``t`` or its volume and first page ``p``): who is meant by an initial is told first by what else is
    written of the same article. The likelihood is that of leaving out a middle name. Ties go to the alphabet. Mentions
    are counted by form and article first, so a popular article is a row for each form, whoever asked for it.
    """
    on = ["issn", "kind", "sur", "given"]
    case = [*on, "t", "p"]
    near = cut(mentions.join(doubtful.select(*on, "open"), on), "doubtful-mentions")
    counts = near.groupBy(*case).agg(F.count(F.lit(1)).alias("n"))
    own = F.array(F.struct(F.col("full")[0].alias("given"), F.substring("second", 1, 1).alias("mid")))
    cases = counts.join(doubtful, on).select(*case, "n", "who", "second", "open", F.explode(F.when(F.col("open"), F.col("persons")).otherwise(own)).alias("x"))
    cases = cases.select(*case, "n", "who", "second", "open", F.col("x.given").alias("name"), "x.mid")
    person = W.partitionBy("issn", "who", "name", "mid")
    said = F.when(F.col("open"), 0).otherwise(F.col("n"))
    prior = F.sum(F.when(F.col("open"), 0).otherwise(1)).over(person)
    beside = lambda key: F.when(F.col(key) == 0, 0).otherwise(F.sum(said).over(W.partitionBy("issn", "who", "name", "mid", key)))
    scored = cases.withColumn("prior", prior).withColumn("near", beside("t")).withColumn("near", F.col("near") + beside("p")).where("open")
    told = F.when((F.col("second") == "") & (F.col("mid") != ""), DROPPED).when((F.col("second") != "") & (F.col("mid") == ""), UNSEEN).otherwise(1.0)
    posterior = F.log(F.col("prior") + ARTICLE * F.col("near") + 0.5) + F.log(told)
    best = scored.groupBy(*case, "who", "n").agg(F.max_by(F.struct("name", "mid"), F.struct(posterior.alias("s"), F.col("name"), F.col("mid"))).alias("b"))
    best = cut(best.select(*case, "who", "b.name", "b.mid", F.col("n").alias("count")), "chosen")
    asked = near.where("open").select("id", "toc", *case)
    return salted_join(asked, best.drop("count"), case, counts=best.select(*case, "count")).select("id", "toc", "issn", "kind", "who", "name", "mid")


def _initials(first: str = "first", full: str = "full") -> Column:
    return F.when(F.size(full) > 0, F.array_distinct(F.transform(full, lambda x: F.substring(x, 1, 1)))).otherwise(F.array(first))


def _title(c: str) -> Column:
    """A title's letters and digits as a number, 0 if it has none."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(bare) > 0, F.xxhash64(bare)).otherwise(F.lit(0))


def _place(volume: str, page: Column) -> Column:
    """Volume and first page as a number, 0 if either is unknown."""
    v = F.regexp_extract(volume, r"([0-9]+)", 1)
    return F.when((v != "") & (page != "") & (page != "0"), F.xxhash64(v, page)).otherwise(F.lit(0))


def _spellings(anchors: DataFrame, entries: DataFrame, authors: DataFrame) -> DataFrame:
    """All mentions of names, (id, toc, issn, t, p, kind, sur, given); ``toc`` tells the author rows from the anchors."""
    first = F.regexp_extract("journal_pages", r"([0-9]{1,7})", 1)
    a = anchors.select(F.col("anchor_id").alias("id"), "issn", _title("article_title").alias("t"), _place("volume", first).alias("p"), F.col("article_author").alias("field"), F.lit(True).alias("many"))
    e = entries.where("issn IS NOT NULL").select("entry_id", "issn", _title("title").alias("t"), _place("volume", F.col("start_page_number").cast("string")).alias("p"))
    t = authors.where("name IS NOT NULL").join(e, "entry_id").select(F.col("author_id").alias("id"), "issn", "t", "p", F.col("name").alias("field"), F.lit(False).alias("many"))
    return cut(_spread(a).withColumn("toc", F.lit(False)), "anchor-names").unionByName(cut(_spread(t).withColumn("toc", F.lit(True)), "toc-names"))


def same_names(anchors: DataFrame, entries: DataFrame, authors: DataFrame) -> DataFrame:
    """(anchor_id, author_id): the anchor's author field includes the person or organisation of the author row, in one journal.

    Spellings are counted per journal, attributed to canonical ones by ``attribute`` (surnames and organisations' words
    within the journal, given names over all); where initials, nicknames or a missing middle name leave open which of
    several persons is meant, ``settle_forms`` takes the likeliest. Pairs are compared as classes of spellings: same
    surname, and given names or initials that don't contradict each other; an organisation by the set of its words, kinds
    spelled out. Rows without issn, name or id take no part; placeholders have no names; the pairs are distinct.
    """
    mentions = _spellings(anchors, entries, authors)
    forms = resolve(mentions)
    on = ["issn", "kind", "sur", "given"]
    doubtful = doubtful_forms(forms)
    picked = cut(settle_forms(mentions, doubtful), "settled").select("id", "toc", "issn", "kind", "who", F.substring("name", 1, 1).alias("initial"), F.array("name").alias("full"), F.col("mid").alias("second"))
    plain = forms.join(doubtful.where("open"), on, "left_anti").select(*on, "n", "who", F.explode(_initials()).alias("initial"), "full", "second")
    named = mentions.join(plain.drop("n"), on).select("id", "toc", "issn", "kind", "who", "initial", "full", "second").unionByName(picked)
    side = lambda toc, key, x: named.where(F.col("toc") == toc).select(F.col("id").alias(key), "issn", "kind", "who", "initial", F.col("full").alias(f"full_{x}"), F.col("second").alias(f"second_{x}"))
    same = ["issn", "kind", "who", "initial"]
    often = forms.select(*same[:3], F.explode(_initials()).alias("initial"), "n").groupBy(*same).agg(F.sum("n").alias("count"))  # no class has more mentions
    pairs = salted_join(side(False, "anchor_id", "a"), side(True, "author_id", "t"), same, counts=often)
    first = (F.size("full_a") == 0) | (F.size("full_t") == 0) | F.arrays_overlap("full_a", "full_t")
    s1, s2 = F.col("second_a"), F.col("second_t")
    second = (s1 == "") | (s2 == "") | ((F.substring(s1, 1, 1) == F.substring(s2, 1, 1)) & ((F.length(s1) == 1) | (F.length(s2) == 1) | (F.levenshtein(s1, s2) <= 1)))
    return pairs.where(first & second).select("anchor_id", "author_id").distinct()


def name_variants(anchors: DataFrame, entries: DataFrame, authors: DataFrame) -> DataFrame:
    """One row per spelling and journal, (issn, kind, spelling, canonical, initial, n): the class it belongs to and how
    often it was typed. Spellings of one class share (issn, kind, canonical, initial)."""
    forms = resolve(_spellings(anchors, entries, authors))
    return forms.select("issn", "kind", F.trim(F.concat_ws(" ", "sur", "given")).alias("spelling"), F.col("who").alias("canonical"), F.explode(_initials()).alias("initial"), "n")
