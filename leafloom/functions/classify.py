"""Genre and reader's goal of a document from cue patterns, as native expressions."""

from __future__ import annotations

from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import BLANK, let, strip

GENRES = ("assignment", "paper", "news", "email", "meeting", "legal", "technical", "article", "other")
# Other names of genres.
ALIASES = {
    "assignment_brief": "assignment", "task": "assignment", "brief": "assignment", "assignment/task": "assignment", "research_paper": "paper",
    "paper": "paper", "study": "paper", "news_article": "news", "email_thread": "email", "thread": "email", "meeting_notes": "meeting",
    "minutes": "meeting", "legal/policy": "legal", "policy": "legal", "contract": "legal", "technical_docs": "technical", "docs": "technical",
    "documentation": "technical", "general_article": "article", "essay": "article", "blog": "article",
}

# Cue patterns of each genre; a genre scores the number of its patterns that occur.
CUES = {
    "assignment": (
        r"\bassignment\b", r"\bproject brief\b|\bbrief\b", r"\bdue (?:date|by|on)\b|\bdue:|\bdeadline\b", r"\bsubmi(?:t|ssion)\b",
        r"\bmarking (?:criteria|rubric)\b|\brubric\b|\bassessed\b|\bassessment\b", r"\bword (?:limit|count)\b|\bmax(?:imum)?\s+\d+\s+(?:pages|words)\b",
        r"\bweight(?:ing)?\b|\bworth \d+\s*%|\b\d+\s*% of (?:your|the) (?:final )?(?:mark|grade|unit)", r"\bdeliverables?\b",
        r"\bplagiarism\b|\bacademic integrity\b", r"\bextension\b", r"\bcoursework\b|\bunit (?:code|coordinator)\b",
    ),
    "paper": (
        r"^#{0,6}\s*abstract\b", r"^#{1,6}\s*(?:\d+\.?\s*)?introduction\b|^\s*(?:\d+\.?\s*)introduction\s*$",
        r"^#{1,6}\s*(?:\d+\.?\s*)?(?:methods?|methodology|materials and methods)\b", r"^#{1,6}\s*(?:\d+\.?\s*)?results?\b",
        r"^#{1,6}\s*(?:\d+\.?\s*)?discussion\b", r"^#{1,6}\s*(?:\d+\.?\s*)?(?:references|bibliography)\b", r"\bet al\.",
        r"\bdoi:|\barxiv\b|doi\.org", r"\bwe (?:propose|show|find|present|study|report|evaluate)\b|\bparticipants\b|\bp\s*[<=]\s*0?\.\d+",
    ),
    "news": (
        r"\((?:reuters|ap|afp|upi|bloomberg)\)|\bassociated press\b|\bstaff reporter\b", r"\bsaid (?:on )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
        r"\baccording to\b", r"\b(?:officials|spokes(?:man|woman|person)|police|authorities) said\b", r"\bpublished\b.{0,40}\b20\d\d\b",
    ),
    "meeting": (
        r"\bmeeting (?:notes|minutes)\b|\bminutes of\b|\bminutes\b", r"\bagenda\b", r"\battendees\b|\bpresent:|\bapologies\b", r"\baction(?:s| items?)\b",
        r"\bnext meeting\b", r"\bdecisions?\b", r"\bchair(?:ed)?\b|\bminute[- ]taker\b|\bnotes by\b",
    ),
    "legal": (
        r"\bhereinafter\b|\bwhereas\b|\bpursuant to\b|\bindemnif", r"\bgoverning law\b|\bjurisdiction\b",
        r"\bthe (?:licensee|licensor|company|supplier|customer|employee|employer|tenant|landlord)\b",
        r"\bterms and conditions\b|\bterms of (?:service|use)\b|\bprivacy policy\b|\bpolicy\b", r"\bclause \d|\bsection \d+(?:\.\d+)*\b",
        r"\bnon-compliance\b|\bbreach\b|\bterminat(?:e|ion)\b", r"\bthis (?:agreement|policy|contract|procedure)\b",
    ),
    "technical": (
        r"^#{1,6}\s*(?:installation|install|usage|getting started|quick ?start|api(?: reference)?|configuration|prerequisites|requirements|examples?|troubleshooting|changelog|cli)\b",
        r"```", r"\bpip install\b|\bnpm (?:install|i)\b|\bcargo (?:add|install)\b|\bapt(?:-get)? install\b", r"\b(?:returns?|parameters?|arguments?|options?|flags?)\b\s*[:|]",
        r"\bsudo\b|\bgit clone\b|\bdocker (?:run|build)\b", r"--[a-z][a-z-]+",
    ),
}
# Points from which a genre counts as found.
POINTS_NEEDED = {"assignment": 4, "paper": 4, "news": 2, "meeting": 3, "legal": 4, "technical": 3}
# Fixed values: (where, pattern, points) of what title and headings add.
BOOSTS = {
    "meeting": ("announced", r"\bmeeting (?:notes|minutes)\b|\bminutes\b", 2), "assignment": ("announced", r"\bassignment\b|\bbrief\b|\bcoursework\b|\bassessment task\b", 2),
    "paper": ("opening", r"^#{0,6}\s*abstract\b", 1), "legal": ("title", r"\bpolicy\b|\bagreement\b|\bterms\b|\bcontract\b", 2),
}
FIELD = r"(?im)^((?:From|To|Cc|Subject|Date|Sent|Reply-To)):\s*\S"

# Fixed values: (pattern, weight) of each goal; a hit in the title counts twice. `m` marks patterns anchored to lines.
GOALS = {
    "execute": (
        (r"\bassignments?\b", 3), (r"\bdue(?!\s+to\b)\b", 2), (r"\bmarks\b|\b(?:final|total|your) mark\b|\bmarking\b", 2), (r"\brubric\b", 3), (r"\bsubmit\b|\bsubmission\b", 3),
        (r"\bdeliverables?\b", 3), (r"\bmarking criteria\b", 3), (r"\bword limit\b|\bword count\b", 2), (r"\bworth \d+\s*%|\b\d+\s*% of (?:your|the) (?:grade|mark|unit)", 3),
        (r"\bassessment task\b|\b(?:project|assignment|task|assessment|design|creative) brief\b", 2), (r"\bmust (?:include|submit|complete)\b", 1),
    ),
    "communicate": (
        (r"(?m)^(?:from|to|subject|cc|sent):", 3), (r"(?m)^(?:hi|hello|hey|dear)\b[^\n]{0,40},", 3), (r"(?m)\b(?:kind |best )?regards\b|\bcheers,|\bthanks,\s*$", 2),
        (r"\bcould you (?:please )?(?:let me know|send|confirm)", 2), (r"\bplease (?:let me know|reply|respond|confirm)\b", 2), (r"^re:", 3),
    ),
    "decide": (
        (r"\bpros and cons\b|\btrade-?offs?\b", 3), (r"\bcompar(?:e|ison|ing)\b", 2), (r"\b(?:vs\.?|versus)\b", 2), (r"\brecommendations?\b", 1), (r"\boptions?\b", 1),
        (r"\bshould (?:we|i)\b", 2), (r"\balternatives?\b", 1),
    ),
    "plan": (
        (r"\broadmaps?\b", 3), (r"\btimeline\b", 2), (r"\bmilestones?\b", 2), (r"\bschedule\b", 1), (r"\bagenda\b", 2), (r"\bnext steps\b", 2), (r"\bproject plan\b", 3),
    ),
    "reference": (
        (r"\bapi (?:reference|docs?)\b|\bdocumentation\b", 3), (r"\bmanual\b|\bhandbook\b", 2), (r"\bspecification\b|\bdatasheet\b", 3), (r"\bfaq\b|\bglossary\b|\bcheat ?sheet\b", 3),
        (r"\bparameters?\b|\breturns?:", 1),
    ),
    "learn": (
        (r"\babstract\b", 2), (r"\bintroduction\b", 1), (r"\bet al\b|\bdoi\b|\barxiv\b|\bjournal\b", 3), (r"\blecture\b|\bchapter \d+\b|\bwikipedia\b", 2),
        (r"\bpaper\b|\barticle\b|\bessay\b", 2), (r"\bhow (?:does|do|to)\b|\bwhy\b|\bexplained?\b", 1),
    ),
}
GOAL_NEEDED = 3
TASK_GENRES, TASK_GOALS = ("assignment", "meeting"), ("execute", "plan")


#: Letters of the shortest word by which a text is passed over without its pattern.
_GATE = 3


def _needed(pattern: str) -> list[str] | None:
    """What, in lower case, every text holds one of that the pattern matches: words of _GATE letters or more, or signs; None where no part tells it."""

    def of(parts) -> set[str] | None:
        runs, told = [""], []
        for kind, value in parts:
            if kind == _parser.LITERAL:
                runs[-1] += chr(value).lower()
                continue
            runs.append("")
            if kind == _parser.BRANCH:
                each = [of(x) for x in value[1]]
                told.append(None if None in each else set().union(*each))
            elif kind == _parser.SUBPATTERN or (kind == _parser.MAX_REPEAT and value[0] > 0):
                told.append(of(value[-1]))
        word = max(runs, key=len)
        signs = [{r} for r in runs if r and not any(x.isalnum() or x.isspace() for x in r)]
        found = [{word}] if len(word) >= _GATE else [t for t in told if t] + signs
        return found[0] if found else None

    found = of(_parser.parse(pattern))
    return sorted(found) if found else None


def _hit(text: Column, pattern: str, flags: str = "im") -> Column:
    return text.rlike(f"(?{flags}){pattern}")


def _seen(text: Column, low: Column, pattern: str, flags: str = "im") -> Column:
    """_hit() that looks for the pattern only where its words occur; low: the text in lower case."""
    words = _needed(pattern)
    hit = _hit(text, pattern, flags)
    if not words:
        return hit
    held = low.contains(words[0])
    for w in words[1:]:
        held = held | low.contains(w)
    return held & hit


def _parts(title: Column, headings: Column, text: Column) -> dict[str, Column]:
    return {
        "head": F.concat(title, F.lit("\n"), F.substring(text, 1, 3500)),
        "long": F.concat(F.substring(text, 1, 6000), F.lit("\n"), headings),
        "announced": F.concat(title, F.lit("\n"), F.substring(headings, 1, 1500)),
        "opening": F.substring(text, 1, 3000),
        "title": title,
        "top": F.substring(text, 1, 1500),
    }


def genre_scores(at: dict[str, Column]) -> dict[str, Column]:
    """Points of each genre, over the parts of a document that _parts() names and `low`, in lower case all that is in any of them."""
    out = {}
    seen = lambda place, pattern, flags: _seen(at[place], at["low"], pattern, flags)
    for genre, cues in CUES.items():
        where = "long" if genre in ("paper", "technical") else "head"
        score = sum((seen(where, p, "im").cast("int") for p in cues), F.lit(0))
        if genre in BOOSTS:
            place, pattern, points = BOOSTS[genre]
            score = score + F.when(seen(place, pattern, "im" if place == "opening" else "i"), points).otherwise(0)
        out[genre] = score
    return out


def detect_genre(title: Column, text: Column) -> Column:
    """struct<genre, strong>: null when nothing stands out; strong when several independent cues agree. Mail headers decide by themselves."""
    text = F.coalesce(text, F.lit(""))
    headings = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"^{BLANK}*#")), "\n")
    told = F.struct(F.coalesce(title, F.lit("")).alias("title"), headings.alias("headings"))
    names = [*_parts(told, told, text), "low"]

    def parts(d: Column) -> Column:
        low = F.lower(F.concat(d["title"], F.lit("\n"), F.substring(text, 1, 6000), F.lit("\n"), d["headings"]))
        return F.struct(*[c.alias(k) for k, c in _parts(d["title"], d["headings"], text).items()], low.alias("low"))

    return let(told, lambda d: let(parts(d), lambda s: _genre_of({k: s[k] for k in names})))


def _genre_of(at: dict[str, Column]) -> Column:
    scores = genre_scores(at)
    fields = F.array_distinct(F.transform(F.regexp_extract_all(at["top"], F.lit(FIELD), F.lit(1)), lambda x: F.lower(x)))
    order = list(scores)
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("minus"), F.lit(k).alias("k"), F.lit(POINTS_NEEDED[g]).alias("need"), F.lit(g).alias("genre")) for k, (g, s) in enumerate(scores.items())]))
    made = lambda g, strong: F.struct(g.alias("genre"), F.lit(strong).alias("strong"))

    def settled(ranked: Column) -> Column:
        best, runner = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        points, need, second = -best["minus"], best["need"], -runner["minus"]
        meeting = F.get(F.filter(ranked, lambda x: x["k"] == order.index("meeting")), F.lit(0))
        return (
            F.when((points >= need) & (points >= second + 2), made(best["genre"], True))
            .when((points >= F.greatest(F.lit(2), need - 2)) & (points > second), made(best["genre"], False))
            .when((-meeting["minus"] >= 2) & _hit(at["head"], r"\bthe (?:meeting|minutes)\b", "i"), made(F.lit("meeting"), False))
            .otherwise(made(F.lit(None).cast("string"), False))
        )

    return F.when(F.size(fields) >= 2, made(F.lit("email"), True)).otherwise(let(ranked, settled))


def valid_genre(c: Column) -> Column:
    key = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), key), key)
    return F.when(named.isin(*GENRES), named)


def settled_genre(cue: Column, model: Column) -> Column:
    """A strong cue wins, then the model's word, then a weak cue, then `other`."""
    return F.coalesce(F.when(cue["strong"], cue["genre"]), valid_genre(model), cue["genre"], F.lit("other"))


def is_task_like(genre: Column, goal: Column) -> Column:
    return F.coalesce(genre.isin(*TASK_GENRES), F.lit(False)) | F.coalesce(goal.isin(*TASK_GOALS), F.lit(False))


def suggest_goal(title: Column, text: Column, kind: Column | None = None) -> Column:
    """The goal with most points (first named wins ties), or null below three. kind: paste, file or url."""
    both = F.struct(F.coalesce(title, F.lit("")).alias("title"), F.substring(F.coalesce(text, F.lit("")), 1, 2000).alias("text"))
    low = lambda s: F.struct(s["title"].alias("title"), s["text"].alias("text"), F.lower(F.concat(s["title"], F.lit("\n"), s["text"])).alias("low"))
    return let(both, lambda s: let(low(s), lambda x: _goal_of(x, kind)))


def _goal_of(at: Column, kind: Column | None) -> Column:
    seen = lambda place, pattern: _seen(at[place], at["low"], pattern, "i")
    rows = []
    for k, goal in enumerate(("execute", "communicate", "decide", "plan", "reference", "learn")):
        score = sum((F.when(seen("title", p), 2 * w).otherwise(0) + F.when(seen("text", p), w).otherwise(0) for p, w in GOALS[goal]), F.lit(0))
        if goal == "learn" and kind is not None:
            score = score + F.when((kind == "file") & F.lower(at["title"]).endswith(".pdf"), 1).otherwise(0)
        rows.append(F.struct((-score).alias("minus"), F.lit(k).alias("k"), F.lit(goal).alias("goal")))
    return let(F.get(F.array_sort(F.array(*rows)), F.lit(0)), lambda best: F.when(-best["minus"] >= GOAL_NEEDED, best["goal"]))


# Labels that say what to act on first.
_RANKS = (
    r"\b(due|deadline|reply by|respond by|submit by|closing date|cut-?off|by when)\b",
    r"\b(deliverables?|hand[- ]?in|what to (?:submit|produce|do|hand)|what you need to do|what you must do|the ask|the decision|task verb|tasks?|actions?|what is needed|needed from you)\b",
    r"\b(start here|first step|next action|next step)\b",
)


def essential_rank(label: Column) -> Column:
    out = F.lit(len(_RANKS))
    for k in range(len(_RANKS) - 1, -1, -1):
        out = F.when(_hit(label, _RANKS[k], "i"), k).otherwise(out)
    return out
