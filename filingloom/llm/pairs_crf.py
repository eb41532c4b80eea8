"""Broken prompt and response pairs (problem 1).

Method: the clauses of an answer are tagged as answer, refusal, echo, foreign or
unfinished by a linear-chain conditional random field, and the share of the text
that each tag covers decides the pair's defect. The field is trained when it is first
used, on sequences of clauses drawn from the labelled ones below (``SEQUENCES`` of
them, always the same). Which language a clause is in comes from character trigrams
of labelled texts: of a bounded sample of a table (``fit_languages``), or of the
labelled clauses.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import keyed, schema_of, unkeyed

#: Sequences the field is trained on, and texts a language is fitted on.
SEQUENCES, SAMPLE = 900, 150
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = ("empty", "copy", "refusal", "truncated", "language")

# ---------------------------------------------------------------- fixed values
#: Frequent function words of each language that the others do not share.
FUNCTION_WORDS = {
    "en": "the of and to in is was were by with for from that this are be an at on which its it has have not would should will than about under over compared year came say says what how why who which when did does how much if i my me you your can".split(),
    "fr": "le la les des du de et en est une un pour par sur dans avec au aux que qui ce cette a été sont pas plus son sa ses leur nous ne se dont où après selon quel quelle quels quelles comment pourquoi je vous cet ces à".split(),
    "de": "der die das den dem des und ist im in von zu mit für auf bei nach durch ein eine einer eines einen wird wurde wurden werden nicht auch als bis ab um vor über unter rund sich aus am zum zur hat haben sind war wie hoch welche warum ich sie bleibt".split(),
    "es": "el la los las del de y en es una un para por con al que se su sus no más fue ha son como tras según durante sobre entre hasta gracias cuál cuáles qué cómo por lo este esta estos la le nos yo usted".split(),
}
#: Stand-ins for nothing.
NOTHING = frozenset("null none nil nan na n/a n.a. empty blank undefined nothing".split()) | {"not available", "no answer", "keine", "aucun", "ninguno", "leer", "vide", "vacío"}
#: Being unable or unwilling, and what it is about, in four languages.
UNWILLING = re.compile(
    r"\b(?:can(?:no|')?t|can not|unable|won['’]?t|will not|must decline|decline|refuse|prefer not|not able|not allowed|not permitted|does not permit|not willing|not something i am|off limits|against (?:my|our)|inappropriate|policy|guidelines|rather not|"
    r"ne peux pas|ne puis|refuse|préfère ne pas|pas autorisé\w*|ne suis pas en mesure|"
    r"kann (?:ich )?nicht|kann ich|darf (?:ich )?nicht|möchte (?:ich )?(?:mich )?nicht|nicht äußern|nicht helfen|nicht beantworten|lehne|"
    r"no puedo|no me está permitido|prefiero no|me niego|no estoy autorizad\w|no es posible que)\b",
    re.I,
)
SELF = re.compile(r"\b(?:i|i['’]m|my|me|assistant|ich|mir|mich|meine|je|moi|mes|yo|mis)\b|\b(?:m|j)['’]|\b(?:no puedo|prefiero|lo siento|siento|suis)\b", re.I)
APOLOGY = re.compile(r"\b(?:sorry|apologi[sz]e|unfortunately|regret|désolé\w*|malheureusement|regrette|leid|leider|bedaure|siento|lamento|lamentablemente|disculp\w+)\b", re.I)
TASK = re.compile(r"\b(?:help|assist|answer\w*|respond|discuss|talk|comment|advice|advise[rd]?|request|question\w*|inquir\w+|topic|assess|professional|aider|répondre|commenter|demande|conseil\w*|helfen|beantworten|äußern|anfrage|frage|berat\w+|ayudar|responder|contestar|hablar|petición|pregunta|asesor\w*|comentar)\b", re.I)
SOURCES = re.compile(r"\b(?:chunks?|excerpts?|context|sections?|provided|retrieved|passages?|information|documents?|filings? (?:do|does)|contain\w*|figure|extraits?|fournis|contiennent|informations?|auszüge|abschnitte|gelieferten?|enthalten|angaben|fragmentos|contienen|datos|proporcionad\w+|recuperad\w+)\b", re.I)
_CITE = re.compile(r"\[[^\[\]\n]*\|[^\[\]\n]*\]")
#: Labels before a question or an answer, which say nothing.
_LABEL = re.compile(r"^\W*(?:q|a|question|answer|frage|antwort|r|réponse|pregunta|p|respuesta)\s?:\s*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_INVISIBLE = re.compile(r"[\xad\u200b-\u200f\u2060\ufeff]")
_ABBREVIATION = "".join(rf"(?<!\b{''.join(f'[{c.upper()}{c.lower()}]' if c.isalpha() else re.escape(c) for c in a)})" for a in ("Inc.", "Corp.", "Co.", "Ltd.", "No.", "S.A.", "U.S."))
_CUT = re.compile(rf"(?<=[.!?]){_ABBREVIATION}\s+|(?<=\])\s+|\n+|(?<=[.!?][\"”»]){_ABBREVIATION}\s+")


def clauses(answer: str) -> list[str]:
    """The answer's clauses; citations of their own go with the clause before, or
    with the first one."""
    out: list[str] = []
    ahead = ""
    for part in _CUT.split(_INVISIBLE.sub("", answer)):
        part = part.strip()
        if not part:
            continue
        if not _WORD.search(_CITE.sub("", part)) and "[" in part:
            if out:
                out[-1] += " " + part
            else:
                ahead += part + " "
        else:
            out.append(ahead + part)
            ahead = ""
    return out if out or not ahead else [ahead.strip()]


_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"|„[^“]*“")
_NAME = re.compile(r"(?<=\S )[A-ZÀ-ÖØ-Þ][^\W\d_]*")


def _trigrams(text: str) -> list[str]:
    """Letter trigrams of the words that are not quoted, cited or names."""
    bare = _NAME.sub(" ", _QUOTED.sub(" ", _CITE.sub(" ", _INVISIBLE.sub("", text))).replace("’", "'"))
    words = re.findall(r"[^\W\d_]+", bare.lower())
    return [g for w in words for g in (f" {w} "[i : i + 3] for i in range(len(w)))]


_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


class Languages:
    """Trigram profiles of languages; ``scores`` is the mean log-probability of a text
    under each, ``least`` what texts of its own language score at least."""

    def __init__(self, texts: Mapping[str, Sequence[str]]) -> None:
        self.names = sorted(texts)
        counts = {k: Counter(g for t in texts[k] for g in _trigrams(t)) for k in self.names}
        known = sorted(set().union(*counts.values()))
        size = len(known) + 1000
        totals = {k: sum(c.values()) for k, c in counts.items()}
        self.rest = np.array([np.log(0.3 / (totals[k] + 0.3 * size)) for k in self.names])
        self.table = {g: np.array([np.log((counts[k][g] + 0.3) / (totals[k] + 0.3 * size)) for k in self.names]) for g in known}
        own = {k: [x for t in texts[k] for c in clauses(t) if (x := self.scores(c)) is not None] for k in self.names}
        self.least = np.array([np.quantile([x[i] for x in own[k]], 0.005) if own[k] else -np.inf for i, k in enumerate(self.names)])

    def scores(self, text: str) -> np.ndarray | None:
        """None for a text with too few letters to tell. The share of a language's own
        function words counts beside the trigrams."""
        grams = _trigrams(text)
        if len(grams) < 8:
            return None
        words = re.findall(r"[^\W\d_]+", text.lower())
        share = np.array([sum(w in _FUNCTION.get(k, ()) for w in words) / len(words) for k in self.names])
        return np.mean([self.table.get(g, self.rest) for g in grams], axis=0) + share

    def strange(self, text: str) -> float:
        """The share of trigrams that stand in none of the profiles."""
        grams = _trigrams(text)
        return sum(g not in self.table for g in grams) / max(1, len(grams))

    def language(self, text: str, default: str = "en") -> int:
        scores = self.scores(text)
        return self.names.index(default) if scores is None else int(scores.argmax())


def fit_languages(df: DataFrame, text: str, lang: str, key: str, names: Sequence[str] = ("en", "fr", "de", "es"), sample: int = SAMPLE) -> Languages:
    """Profiles from ``sample`` labelled rows a language, the same ones every time: the
    rows of least hash in ``sample`` groups. Only those come to the driver. A language
    without rows is fitted on the labelled clauses."""
    label = F.lower(F.col(f"`{lang}`"))
    rows = df.where(label.isin(*names) & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("_k"), label.alias("_l"), F.xxhash64(F.lit(3), F.col(f"`{key}`")).alias("_h"))
    chosen = rows.groupBy("_l", F.pmod("_h", F.lit(sample))).agg(F.min(F.struct("_h", "_k")).alias("_x")).select("_l", F.col("_x._k").alias("_k"))
    texts = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(chosen), "_k").select("_l", "_t")  # at most sample rows a language
    got: dict[str, list[str]] = {}
    for r in sorted(tuple(r) for r in texts.collect() if r["_t"]):
        got.setdefault(r[0], []).append(r[1])
    own = labelled_texts()
    return Languages({k: got.get(k, []) + 3 * own[k] for k in names})


def complete(answer: str) -> bool:
    """Is the answer closed by a full stop or the like, or by a citation?"""
    tail = _INVISIBLE.sub("", answer).rstrip()
    if tail.count("[") > tail.count("]") and "|" in tail[tail.rfind("[") :] or re.search(r"\[[^\]]*$", tail):
        return False
    return bool(re.search(r"(?:[.!?…。][\"'”’»)\]]*|\])$", tail))


FEATURES = (
    "bias", "unwilling", "unwilling+self", "unwilling+task", "apology", "self", "self+bare", "bare", "offer", "sources", "sources+unwilling", "sources+lack", "lack", "echo all", "echo most", "echo some", "in question", "asks",
    "other language", "other language clearly", "own language", "unlike own", "no language", "last", "last open", "last open echo", "last open bracket", "cited", "number", "no own words", "only",
)


def features(question: str, answer: str, languages: Languages | None = None) -> np.ndarray:
    """(clauses, features) of 0 and 1."""
    languages = languages or own_languages()
    parts = clauses(answer)
    out = np.zeros((len(parts), len(FEATURES)))
    asked = {w for w in _WORD.findall(_INVISIBLE.sub("", question).lower())}
    flat = " ".join(_WORD.findall(question.lower()))
    own = languages.language(question)
    ended = complete(answer)
    for i, part in enumerate(parts):
        bare = _LABEL.sub("", _CITE.sub(" ", part))
        words = _WORD.findall(bare.lower())
        new = [w for w in words if w not in asked]
        scored = languages.scores(bare)
        ahead = 0.0 if scored is None else float(np.delete(scored, own).max(initial=-np.inf) - scored[own])
        unlike = scored is not None and (ahead > 0 and bool(scored[own] < languages.least[own] - 0.5) or languages.strange(bare) > 0.5)
        echo = 1 - len(new) / len(words) if words else 0
        said = _QUOTED.sub(" ", bare)
        lack = bool(LACK.search(said))
        unwilling, self_, sources = (bool(p.search(said)) for p in (UNWILLING, SELF, SOURCES))
        last = i == len(parts) - 1
        cited, number = bool(_CITE.search(part)), bool(re.search(r"\d", bare))
        row = {
            "bias": 1, "unwilling": unwilling, "unwilling+self": unwilling and self_, "unwilling+task": unwilling and bool(TASK.search(said)), "apology": bool(APOLOGY.search(said)),
            "self": self_, "self+bare": self_ and not sources and not number, "bare": not cited and not number and not sources, "offer": bool(OFFER.search(said)),
            "sources": sources, "sources+unwilling": sources and unwilling, "sources+lack": sources and lack, "lack": lack, "echo all": bool(words) and not new, "echo most": 0.85 <= echo < 1, "echo some": 0.5 <= echo < 0.85,
            "in question": len(words) > 2 and " ".join(words) in flat, "asks": bare.rstrip(" \"”»").endswith("?"),
            "other language": 0 < ahead <= 0.35, "other language clearly": ahead > 0.35, "own language": scored is not None and ahead <= 0 and not unlike, "unlike own": unlike, "no language": scored is None,
            "last": last, "last open": last and not ended, "last open echo": last and not ended and bool(words) and not new, "last open bracket": last and bool(re.search(r"\[[^\]]*$", part)),
            "cited": cited, "number": number, "no own words": not words, "only": len(parts) == 1,
        }
        out[i] = [float(row[f]) for f in FEATURES]
    return out


#: Labelled clauses: (question, [(clause, tag), ...]). Written for this purpose.
TRAINING: list[tuple[str, list[tuple[str, str]]]] = [
    ("What was Alder Works Inc.'s revenue in fiscal 2014?", [("Alder Works Inc. reported revenue of $4.1 million in fiscal 2014 [AW|1|10-K:I-1|0].", "answer"), ("Costs rose by 3.2% from the prior year [AW|1|10-K:I-1|2].", "answer")]),
    ("How did Birch Metals explain the change in orders during 2019?", [("Orders fell because of weak demand at the Lund plant [BM|2|10-K:II-7|1].", "answer")]),
    ("How did Birch Metals explain the change in orders during 2019?", [("I'm sorry, but I cannot help with this request.", "refusal")]),
    ("Who supplies Cedar Foods with valves, and under what terms?", [("As a language model I am not able to answer questions about companies.", "refusal")]),
    ("Who supplies Cedar Foods with valves, and under what terms?", [("I must decline to respond to this question.", "refusal"), ("Is there anything else I can do for you?", "answer")]),
    ("Which risks does Cedar Foods name?", [("My guidelines do not allow me to comment on this topic [CF|3|10-K:I-1|0].", "refusal")]),
    ("Which risks does Cedar Foods name?", [("I won't discuss this company.", "refusal")]),
    ("Which risks does Cedar Foods name?", [("Giving advice here would be inappropriate for me; please ask a professional.", "refusal")]),
    ("Which risks does Cedar Foods name?", [("Answering this is against my policy.", "refusal")]),
    ("Which risks does Cedar Foods name?", [("That is nothing I am willing to talk about, so I prefer not to answer.", "refusal")]),
    ("Which risks does Cedar Foods name?", [("Unfortunately I can't assist with that.", "refusal")]),
    ("Which risks does Cedar Foods name?", [("The provided excerpts do not contain the risks of Cedar Foods, so I cannot say which they are.", "answer")]),
    ("What was Dune Capital's backlog in fiscal 2016?", [("I'm unable to find the backlog of Dune Capital in the retrieved context; the chunks cover other years.", "answer")]),
    ("What was Dune Capital's backlog in fiscal 2016?", [("There is not enough information in the sections to say how large the backlog was.", "answer")]),
    ("What was Dune Capital's backlog in fiscal 2016?", [("What was Dune Capital's backlog in fiscal 2016?", "echo")]),
    ("What was Dune Capital's backlog in fiscal 2016?", [("Dune Capital's backlog in fiscal 2016", "echo")]),
    ("What was Dune Capital's backlog in fiscal 2016?", [("What was Dune Capital's backlog in fiscal 2016?", "echo"), ("Backlog came to $12 million at the end of the year [DC|4|10-K:I-1|0].", "answer")]),
    ("Who supplies Elm Energy, Inc. with pumps, and under what terms?", [("WHO SUPPLIES ELM ENERGY, INC. WITH PUMPS, AND UNDER WHAT TERMS?", "echo")]),
    ("Who supplies Elm Energy, Inc. with pumps, and under what terms?", [("who supplies Elm Energy, Inc. with pumps, and under what terms?", "echo")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("No [FH|5|10-K:I-3|0]", "answer")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("44,200 units [FH|5|10-K:I-3|0]", "answer")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("- No claims were open at the end of the year [FH|5|10-K:I-3|0]", "answer"), ("- Costs of $2 million were booked [FH|5|10-K:I-3|1]", "answer")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("No claims about the plant were op", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("No claims were open in 2020 [FH|5|10-K:I-3|0].", "answer"), ("The company attributed the ch", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("No claims were open in 2020 [FH|5|10-", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("Spending came to $9 million, and work should end in 2023 [", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("- Backlog rose [FH|5|10-K:I-3|0]", "answer"), ("- Spending of roughly $5,", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("Yes [FH|5", "unfinished")]),
    ("Did Fern Holdings disclose any legal proceedings in 2020?", [("Der Vorstand prüft, ob das Werk ab 2021 geschlossen wird [FH|5|10-K:I-3|0].", "foreign"), ("Die Umsätze stiegen um 4%, vor allem wegen der Nachfrage.", "foreign")]),
    ("What was Grove Systems' net income in fiscal 2018?", [("Le chiffre d’affaires a progressé de 3% en 2018 grâce à la demande [GS|6|10-K:I-1|0].", "foreign")]),
    ("What was Grove Systems' net income in fiscal 2018?", [("Las ventas crecieron un 5% en 2018 gracias a la demanda [GS|6|10-K:I-1|0].", "foreign")]),
    ("What was Grove Systems' net income in fiscal 2018?", [("Net income was about $3 million in the “Café d’Été” line [GS|6|10-K:I-1|0].", "answer")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Der Umsatz der Gruppe stieg um 4% auf 20 M€ [HW|7|10-K:I-1|0].", "answer"), ("Rund 300 Beschäftigte erhalten höhere Löhne [HW|7|10-K:I-1|1].", "answer")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Spending on the plant came to $9 million, and work should end in 2023 [HW|7|10-K:I-1|0].", "foreign")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Dabei kann ich leider nicht helfen.", "refusal")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Zu diesem Thema möchte ich mich nicht äußern.", "refusal")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Die Abschnitte enthalten keine Angaben zum Umsatz von Hain Werke.", "answer")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Die Umsätze der Grup", "unfinished")]),
    ("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", [("Wie hoch war der Umsatz von Hain Werke im Jahr 2018?", "echo")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("La société a cédé l’activité pour un prix de 12 M€ [IM|8|10-K:I-1|0].", "answer")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("The company attributed the change to lower demand at the site [IM|8|10-K:I-1|0].", "foreign")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("Je suis désolé, je ne peux pas répondre à cette question.", "refusal")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("Je ne suis pas autorisé à commenter cette société.", "refusal")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("Les extraits ne contiennent pas le chiffre demandé.", "answer")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", "echo")]),
    ("Quel était le chiffre d’affaires d’Iris Mobilité en 2017 ?", [("Le conseil a approuvé le fin", "unfinished")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Las ventas de la división crecieron un 4% en 2015 [JM|9|10-K:I-1|0].", "answer")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Sales grew by 4% compared with the year before [JM|9|10-K:I-1|0].", "foreign")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Lo siento, no puedo responder a esta pregunta.", "refusal")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Prefiero no comentar sobre esta empresa.", "refusal")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Los fragmentos no contienen datos sobre las ventas.", "answer")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("Según la dirección, la dem", "unfinished")]),
    ("¿Cuáles fueron las ventas de Jara Minas en 2015?", [("¿Cuáles fueron las ventas de Jara Minas en 2015?", "echo")]),
]


#: More labelled clauses by language: refusals without the usual words, closing offers,
#: what is said when the sources lack the facts, and answers that use words of refusals.
MORE: dict[str, dict[str, list[str]]] = {
    "en": {
        "refusal": ["I would sooner not get into that.", "That is beyond what I was made for.", "I have to pass on this one.", "I choose to stay silent on this subject.", "No comment from me on that.", "I am afraid I will leave this for somebody else.", "This lies outside my role.", "I keep out of matters like these.", "It is better that I say nothing about it.", "I shall not go into that.", "Let me leave that aside.", "I don't do this kind of thing.", "I will not talk about it, even though the chunks are at hand.", "This subject is off limits for me, although the excerpts cover it.", "Even with the context given I would rather not say.", "My rules do not let me talk about filings of this company."],
        "offer": ["Is there anything else you need?", "Let me know what else I can do.", "Please speak with a licensed adviser.", "Ask me about something else."],
        "lack": ["I'm unable to find the figure in the retrieved chunks.", "The excerpts I was given do not name it, so I can't tell.", "I cannot determine it from the provided context.", "I see no information about it in the sections.", "The retrieved passages say nothing about this."],
        "answer": ["The board declined to comment on the claims at the plant [AA|1|10-K:I-3|0].", "The supplier refused two deliveries in 2016 [AA|1|10-K:I-3|0].", "Its policy does not permit sales below cost [AA|1|10-K:I-3|1].", "Management was unable to discuss terms before May 2019 [AA|1|10-K:I-3|2].", "Costs rose with wages, which management could not avoid.", "Weak demand was the main reason.", "The brand “Le Petit Jardin d’Or” belongs to the group [AA|1|10-K:I-1|0]."],
    },
    "fr": {
        "refusal": ["Je préfère laisser cela de côté.", "Ce n’est pas mon rôle.", "Je passe mon tour.", "Je n’entre pas dans ce sujet.", "Je n’en parlerai pas, même si les extraits sont là."],
        "offer": ["Puis-je faire autre chose pour vous ?", "N’hésitez pas à me demander autre chose."],
        "lack": ["Je ne trouve pas ce chiffre dans les extraits fournis.", "Les extraits n’indiquent rien à ce propos."],
        "answer": ["La hausse des salaires a pesé sur la marge [AA|1|10-K:I-1|0].", "Le conseil a refusé l’offre en 2016 [AA|1|10-K:I-1|0].", "Une baisse de la demande explique la variation."],
    },
    "de": {
        "refusal": ["Das lasse ich lieber.", "Das liegt außerhalb meiner Aufgabe.", "Dazu sage ich nichts.", "Davon halte ich mich fern.", "Darüber spreche ich nicht, auch wenn die Abschnitte vorliegen."],
        "offer": ["Kann ich sonst etwas für Sie tun?", "Fragen Sie mich gern etwas anderes."],
        "lack": ["Ich finde die Zahl in den gelieferten Auszügen nicht.", "Die Abschnitte sagen dazu nichts."],
        "answer": ["Höhere Löhne belasteten die Marge [AA|1|10-K:I-1|0].", "Der Vorstand lehnte das Angebot 2016 ab [AA|1|10-K:I-1|0].", "Die schwächere Nachfrage war der Grund."],
    },
    "es": {
        "refusal": ["Prefiero dejarlo a un lado.", "Eso queda fuera de mi función.", "De eso no digo nada.", "Me abstengo de entrar en el tema.", "No hablaré de ello, aunque los fragmentos estén ahí."],
        "offer": ["¿Puedo hacer algo más por usted?", "Pregúnteme otra cosa."],
        "lack": ["No encuentro la cifra en los fragmentos recuperados.", "Los fragmentos no dicen nada de esto."],
        "answer": ["El alza de los salarios redujo el margen [AA|1|10-K:I-1|0].", "El consejo rechazó la oferta en 2016 [AA|1|10-K:I-1|0].", "La menor demanda fue la causa."],
    },
}
#: Clauses in languages that no profile is fitted on.
OTHER = ["De omzet van de groep steeg door de vraag naar pompen.", "I ricavi del gruppo sono cresciuti grazie alla domanda.", "Выручка группы выросла из-за спроса.", "グループの売上高は需要により増加しました。", "Przychody grupy wzrosły dzięki popytowi.", "A receita do grupo cresceu com a procura."]
#: Clauses too short or bare for a language.
BARE = ["44,200 [AA|1|10-K:I-1|0].", "31% [AA|1|10-K:I-1|0].", "31% [AA|1|10-K:I-1|0]", "$4.1 M.", "2016: 12; 2017: 14.", "No [AA|1|10-K:I-1|0]", "Yes [AA|1|10-K:I-1|0].", "Oui [AA|1|10-K:I-1|0]", "Ja [AA|1|10-K:I-1|0].", "Sí [AA|1|10-K:I-1|0]", "About 3.5% [AA|1|10-K:I-1|0]"]
#: Closing words after an answer.
CLOSING = ["I hope that is what you were after.", "Happy to give more detail.", "I hope it is of use.", "I can show the sources too."]
#: What the sources lack.
LACK = re.compile(r"\b(?:do(?:es)? not|don['’]?t|not enough|nothing|no information|unable to find|cannot (?:find|determine)|can['’]?t find|not find|ne contiennent|n['’]indiquent|ne trouve|nicht enthalten|enthalten keine|keine|nichts|nicht finden|finde|no contienen|no encuentro|no dicen)\b", re.I)
OFFER = re.compile(r"\b(?:anything else|something else|what else|speak with|consult|adviser|professional|autre chose|sonst|etwas anderes|algo más|otra cosa)\b", re.I)


def _question_language(question: str) -> str:
    return {"W": "de", "Q": "fr", "¿": "es"}.get(question[0], "en") if question[:3] not in ("Wha", "Whi", "Who") else "en"


def labelled_texts() -> dict[str, list[str]]:
    """The labelled clauses by language, with the function words: what languages are
    fitted on where no table is given."""
    out: dict[str, list[str]] = {k: [" ".join(v)] + [c for group in MORE[k].values() for c in group] for k, v in FUNCTION_WORDS.items()}
    for question, labelled in TRAINING:
        lang = _question_language(question)
        out[lang].append(question)
        out[lang] += [c for c, tag in labelled if tag in ("answer", "refusal")]
    return out


@lru_cache(1)
def own_languages() -> Languages:
    return Languages(labelled_texts())


def sequences(n: int = SEQUENCES) -> list[tuple[str, list[tuple[str, str]]]]:
    """Labelled sequences of one to five clauses, drawn from the labelled clauses; the
    same ones every time. A bare clause carries the tag of the clauses around it, an
    offer after a refusal belongs to it, and an excuse after a lack of facts to that."""
    r = random.Random(11)
    pool: dict[str, dict[str, list[str]]] = {k: {kind: list(v) for kind, v in MORE[k].items()} for k in MORE}
    questions: dict[str, list[str]] = {k: [] for k in MORE}
    for question, labelled in TRAINING:
        lang = _question_language(question)
        questions[lang].append(question)
        for clause, tag in labelled:
            if tag in ("answer", "refusal"):
                pool[lang]["lack" if SOURCES.search(clause) and not _CITE.search(clause) and tag == "answer" else tag].append(clause)
    out = list(TRAINING)
    while len(out) < n + len(TRAINING):
        lang, other = r.sample(sorted(pool), 2)
        lang = "en" if r.random() < 0.5 and other != "en" else lang
        own, far, question = pool[lang], pool[other], r.choice(questions[lang])
        some = lambda kind, k=1: [r.choice(own[kind]) for _ in range(k)]  # noqa: B023, E731
        kind = r.randrange(11)
        if kind == 0 and r.random() < 0.5:
            made = [(r.choice(BARE), "answer") for _ in range(r.randint(1, 2))]
        elif kind <= 1:
            made = [(c, "answer") for c in some("answer", r.randint(1, 4))]
            if r.random() < 0.3:
                made.append((r.choice([*own["offer"], *CLOSING]), "answer"))
            if r.random() < 0.3:
                made.insert(r.randint(0, len(made)), (r.choice(BARE), "answer"))
        elif kind == 2:
            made = [(question, "echo"), *((c, "answer") for c in some("answer", r.randint(1, 2)))]
        elif kind == 3:
            made = [(question, "echo")] * r.randint(1, 2)
            if r.random() < 0.3:
                made[-1] = (question.rstrip("?!. "), "echo")
            if r.random() < 0.5:
                made = [(r.choice([c.upper(), c.lower(), "[AA|1|10-K:I-1|0] " + c, f'"{c}"', f"Question: {c}", c]), t) for c, t in made]
        elif kind <= 5:
            own = far if r.random() < 0.3 else own  # a refusal is one in any language
            made = [(c, "refusal") for c in some("refusal", r.randint(1, 2))] + [(c, "refusal") for c in some("offer", r.randint(0, 1))]
            if r.random() < 0.3:
                made[0] = (made[0][0] + " [AA|1|10-K:I-1|0]", "refusal")
            elif r.random() < 0.4:
                made.append(("See [AA|1|10-K:I-1|0].", "refusal"))
        elif kind == 6:
            made = [(c, "answer") for c in some("lack")]
            if r.random() < 0.6:
                made.append((r.choice({"en": ["I cannot say which.", "So I can't answer that."], "fr": ["Je ne peux pas le dire."], "de": ["Das kann ich nicht sagen."], "es": ["No puedo decirlo."]}[lang]), "answer"))
        elif kind == 7:
            made = [(c, "foreign") for c in (r.sample(far["answer"], 2) if r.random() < 0.6 else r.sample(OTHER, r.randint(1, 2)))]
            if r.random() < 0.6:
                made.insert(r.randint(1, len(made)), (r.choice(BARE), "foreign"))
        elif kind == 8:
            made = [(r.choice(far["answer"]), "foreign") for _ in range(r.randint(1, 2))] + [(c, "answer") for c in some("answer", 2)]
        else:
            home = own if r.random() < 0.8 else far
            made = [(r.choice(home["answer"]), "answer" if home is own else "foreign") for _ in range(r.randint(1, 3))]
            whole = made[-1][0]
            cut = whole[: r.randint(8, max(9, len(whole) - 6))].rstrip(" .?!]")
            if r.random() < 0.25:
                cut += r.choice([" [", " [AA", " [AA|1|10-"])
            if len(made) > 1 and r.random() < 0.25:  # cut after words that the question has too
                words = question.rstrip("?!. ").split()
                at = r.randrange(max(1, len(words) - 3))
                cut = " ".join(words[at : at + r.randint(1, 4)])
            made[-1] = (cut, "unfinished")
        if len(clauses("\n".join(c for c, _ in made))) == len(made):
            out.append((question, made))
    return out


class Field:
    """A linear-chain conditional random field over clause tags."""

    def __init__(self, unary: np.ndarray, step: np.ndarray) -> None:
        self.unary, self.step = unary, step

    @staticmethod
    def _marginals(score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag marginals (sequences, clauses, tags) and summed pair marginals of
        sequences of one length, all at once."""
        m, n, k = score.shape
        forward, backward = np.zeros((m, n, k)), np.zeros((m, n, k))
        forward[:, 0] = score[:, 0]
        for t in range(1, n):
            forward[:, t] = score[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1)
        for t in range(n - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        node = np.exp(forward + backward - total)
        edge = np.zeros((k, k))
        for t in range(1, n):
            edge += np.exp(forward[:, t - 1, :, None] + step + (score[:, t] + backward[:, t])[:, None, :] - total).sum(0)
        return node, edge

    @classmethod
    def train(cls, data: list[tuple[np.ndarray, np.ndarray]], rounds: int = 600, rate: float = 2.0, decay: float = 0.0003) -> Field:
        """Gradient ascent on the penalised log-likelihood; the same data give the same weights."""
        k = len(TAGS)
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for x, y in data:
            by.setdefault(len(y), []).append((x, y))
        groups = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for _, g in sorted(by.items())]
        unary, step = np.zeros((data[0][0].shape[1], k)), np.zeros((k, k))
        for _ in range(rounds):
            gu, gs = -decay * unary * len(data), -decay * step * len(data)
            for x, y in groups:
                node, edge = cls._marginals(x @ unary, step)
                gu += np.einsum("mnf,mnk->fk", x, np.eye(k)[y] - node)
                gs -= edge
                np.add.at(gs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            unary += rate * gu / len(data)
            step += rate * gs / len(data)
        return cls(unary, step)

    def tag(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags of the clauses (Viterbi)."""
        score = x @ self.unary
        back = np.zeros(score.shape, np.int64)
        best = score[0]
        for t in range(1, len(score)):
            m = best[:, None] + self.step
            back[t] = m.argmax(0)
            best = m.max(0) + score[t]
        out = np.zeros(len(score), np.int64)
        out[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def labelled(data: list[tuple[str, list[tuple[str, str]]]], languages: Languages | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and tag numbers of labelled sequences."""
    out = []
    for question, tagged in data:
        x = features(question, "\n".join(c for c, _ in tagged), languages)
        if len(x) != len(tagged):
            raise AssertionError(f"clauses of the training text do not match: {tagged}")
        out.append((x, np.array([TAGS.index(t) for _, t in tagged])))
    return out


def trained(languages: Languages | None = None) -> Field:
    return _own_field() if languages is None else Field.train(labelled(sequences(), languages))


@lru_cache(1)
def _own_field() -> Field:
    return Field.train(labelled(sequences()))


def is_empty(answer: str | None) -> bool:
    """Null, blank, invisible, bare punctuation or brackets, or a stand-in for nothing."""
    if answer is None:
        return True
    bare = _INVISIBLE.sub("", _CITE.sub(" ", answer)).strip()
    if re.search(r"\[[^\]]*$", bare):
        return False
    words = _WORD.findall(bare)
    return not words or bare.strip(" \t\n.()[]{}<>\"'“”-–—*_").lower() in NOTHING


def judge(question: str | None, answer: str | None, field: Field, languages: Languages | None = None) -> tuple[str | None, dict[str, float]]:
    """(defect or None, share of the prose under each tag)."""
    if is_empty(answer):
        return "empty", {}
    asked = question or ""
    parts = clauses(answer)
    tags = field.tag(features(asked, answer, languages))
    weight = [len("".join(_WORD.findall(_CITE.sub(" ", p)))) or 1 for p in parts]
    total = sum(weight)
    share = {t: sum(w for w, g in zip(weight, tags) if TAGS[g] == t) / total for t in TAGS}
    if share["echo"] > 1 - 1e-9:
        return "copy", share
    if share["refusal"] > share["answer"]:
        return "refusal", share
    if TAGS[tags[-1]] == "unfinished":
        return "truncated", share
    if share["foreign"] > share["answer"]:
        return "language", share
    return None, share


def broken_pairs(df: DataFrame, keys: list[str], question: str, answer: str, only_defects: bool = False, languages: Languages | None = None) -> DataFrame:
    """One row per row of ``df``: keys, ``defect`` (null for a sound pair) and the
    shares of the answer's prose tagged ``answer``, ``refusal``, ``echo``,
    ``foreign``, ``unfinished`` (null for an empty answer).

    Null and blank answers are 'empty'; a null question counts as an empty one, so
    nothing echoes it and its language is taken as English. Stop reason and
    citation flag are no evidence and are not read. Extra columns are ignored.
    ``languages`` are those of ``fit_languages``.
    """
    base = keyed(df, keys, _q=question, _t=answer)
    schema = schema_of(df, keys, "defect string, " + ", ".join(f"{t} double" for t in TAGS))
    field = trained(languages)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(q, a, field, languages) for q, a in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
            keep = pa.array([i for i, m in enumerate(made) if m[0] or not only_defects], pa.int64())
            made = [m for m in made if m[0] or not only_defects]
            shares = [pa.array([m[1].get(t) for m in made], pa.float64()) for t in TAGS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(keep) for i in range(width)), pa.array([m[0] for m in made], pa.string()), *shares], names=schema.names)

    return unkeyed(base.mapInArrow(run, schema), keys)
