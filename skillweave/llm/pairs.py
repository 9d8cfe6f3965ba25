"""Defects of prompt-response pairs: empty, refusal, copy, language, truncated.

Copies: a response is compressed with its prompt as zstandard dictionary. One that is nothing but material of the
prompt costs little more than the frame and a few references. Refusals and languages are told by dictionaries; a
language without one by having few English function words and hardly a word that is frequent in the English responses.
Truncation: a terminal-context model, counted over all responses, has how often each pair of words ends a response and
how often it goes on; a response that stops without a final mark in a pair that hardly ever ends one breaks off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

#: Bytes that zstandard needs for a response that is one reference into the prompt (frame, block and one sequence).
ONE_REFERENCE = 18
#: Bytes beyond those, per byte of response, up to which the response is all copy; and the length below which a
#: response that breaks off is no copy even so.
COPY_SHARE, COPY_BYTES = 0.10, 100
#: Most bytes that a copy takes of those that it would take without the prompt.
WITHOUT_SHARE = 0.35
#: Share of ends below which a pair of words doesn't end a response.
END_SHARE = 0.25
#: Words from which on a text without a known language is judged, the share of English function words above which it is
#: English, the share of its other words that English responses must know, and how many of their words are carried.
FOREIGN_WORDS, ENGLISH_SHARE, KNOWN_SHARE, VOCABULARY = 6, 0.25, 0.2, 20_000

# Fillers (letters only) and texts of failures.
FILLERS = frozenset(
    "na none null nil nan todo tbd tba tbc empty nooutput noresponse noanswer nostatement undefined placeholder pending blank unknown missing notapplicable notavailable".split()
)
_FAILURE = re.compile(
    r"^\W*(?:error|exception|fatal|traceback|failure|failed)\b\W*(?:\w+\W*){0,2}$"
    r"|^\W*(?:error|exception|fatal|traceback|failure|failed)\b\s*[:\-(\[].{0,120}\b(?:time[d]?[ -]?out|exceeded|connection|reset|refused|failed|failure|null|none|undefined|exception|invalid|denied|unavailable"
    r"|limit|code|status|server|network|api|token|not found|unauthori[sz]ed|overload(?:ed)?|gateway|no (?:response|output|answer)|unable|could not|cannot|aborted|[45]\d\d)\b.{0,120}$"
    r"|^\W*(?:http\s*)?(?:error\s*)?[45]\d\d\b.{0,60}$"
    r"|^.{0,40}\b(?:timed out|quota exceeded|rate limit(?:ed| exceeded)?|connection (?:reset|refused|aborted)|internal server error|service unavailable|bad gateway|stack trace)\b.{0,40}$",
    re.I | re.S,
)

# Ways of declining to answer, as they open a response after a greeting. Declining further on, or in the
# mouth of somebody else, is part of an answer.
_GREETING = (
    r"(?:\W*(?:hello|hi|hey|greetings|good (?:day|morning|afternoon|evening)|dear \w+|hm+|well|oh|ah|okay|ok|sure|certainly|of course|thanks?(?: you)?(?: for [^.!?]{1,60}| very much| so much)?)\b[^\w\"'“‘]*)*"
)
_LEAD = r"(?:\W*(?:but|however|unfortunately|regrettably|sadly|alas|sorry|(?:my |our )?(?:sincere )?apologies|respectfully|at this (?:time|point|stage)|for (?:safety|legal|policy|privacy) reasons|(?:given|because of|based on|due to) [^,.]{1,60}),?\W+)*"
_REFUSAL = re.compile(
    "^" + _GREETING + "(?:" + "|".join(
        (
            _LEAD + r"(?:i|we)(?:'m| am|'re| are| was| were)? (?:really |very |so |truly |deeply )?(?:sorry|afraid)\b",
            _LEAD + r"(?:i|we)(?:'m| am|'re| are) (?:not able|unable|not permitted|not allowed|not in a position|not comfortable|not going)\b",
            _LEAD + r"(?:i|we) (?:cannot|can ?not|can't|won't|will not|couldn't|could not|shouldn't|should not|mustn't|must not|wouldn't|would not)\b",
            _LEAD + r"(?:i|we) (?:don't|do not) (?:have|think|feel|believe|know|provide|give|write|answer|produce|help|assist|comment|discuss|engage|offer|want|wish)\b",
            _LEAD + r"(?:i|we) (?:must|have to|need to|respectfully|will have to) (?:respectfully )?(?:decline|refuse|pass)\b",
            _LEAD + r"(?:i|we)(?:'d| would) (?:rather|prefer) not\b",
            r"\W*(?:my|our|sincere|please accept my) apologies\b|\W*(?:i|we) apologi[sz]e\b|\W*(?:i|we) (?:deeply |sincerely )?regret\b",
            _LEAD + r"as an? (?:ai|artificial|language|virtual|digital|automated)\b[\w -]{0,25}\b(?:model|assistant|system|bot)\b",
            _LEAD + r"(?:this|that|it) (?:is|would|isn't|wouldn't|'s)(?: be)?(?: not)?(?: be)? (?:appropriate|something|possible) (?:for me|(?:that )?i)\b",
            _LEAD + r"(?:this|that|your|the) (?:request|prompt|question|topic|task|statement|sentence)\b[^.!?]{0,40}\b(?:goes against|violates|conflicts with|is against|falls? outside|is (?:outside|beyond)|(?:can(?:not|'t| not)|could not|will not|won't) be)\b",
            _LEAD + r"there (?:is|was|isn't|'s)(?: not| n't)? (?:enough|insufficient|too little) (?:detail|information|context)\b[^.!?]{0,40}\b(?:for me|to (?:answer|write|give|produce))\b",
            _LEAD + r"no (?:skill )?(?:statement|answer|sentence|response) (?:was|is|can be|could be|will be) (?:written|given|provided|produced)\b",
            r"\W*(?:unfortunately|regrettably|sadly|sorry|alas)\b[^.!?]{0,200}\b(?:falls? outside|will not be (?:given|provided|written|answered|produced)|can(?:not|'t| not) be (?:given|provided|written|answered|produced)"
            r"|(?:is|are) (?:not (?:something|possible|available|permitted|allowed|appropriate)|unavailable|beyond|outside)|i (?:can't|cannot|can not|am unable|must decline|won't)|unable to|declin(?:e|ed|ing))\b",
        )
    ) + ")",
    re.I | re.S,
)

# Frequent function words by language.
LANGUAGES = {
    "en": "the and of to in for with by on at from as is are be that this or an a using through via after before during under while when so who can it its which into within across without against about",
    "de": "der die das und den dem des mit auf für von zu im ist ein eine einer eines nach bei aus damit werden durch nicht oder sich vor als auch an wird sowie um",
    "fr": "le la les et des du de un une pour avec dans sur par au aux en est ce afin sont que qui chaque sans plusieurs à selon avant après lors d l",
    "es": "el la los las y de del un una para con en por que se al es lo como su antes durante cada sin varios según mediante a",
    "it": "il lo la gli le i e di del della dei delle un una per con in su da che si al alle così dopo prima ogni senza tramite durante nel nella",
    "pt": "o a os as e de do da dos das um uma para com em por que se ao no na nos nas antes durante cada sem segundo através",
    "nl": "de het een en van in op voor met door aan is te zijn naar bij uit om wordt worden als niet of elke tijdens volgens zodat",
    "id": "yang dan di ke dari untuk dengan pada dalam agar supaya oleh selama setelah sebelum adalah ini itu setiap sesuai secara tidak tetap semua",
    "pl": "i w na z do się nie jest od przez dla po oraz aby przed podczas każdą zgodnie ze lub",
    "sv": "och att det som en på är av för med till den har inte om ett från vid under före efter enligt så",
    "tr": "ve bir bu için ile de da olarak her önce sonra göre gibi kadar daha en",
    "da": "og det som på er af til med har ikke ved efter skal hver ved samt mellem",
    "fi": "ja ei että joka kun tai sekä ovat ennen jälkeen mukaan kanssa varten myös kaikki",
    "ro": "și cu din pentru care este sunt sau prin după înainte fiecare pe ale fără",
    "cs": "se je že pro od před aby nebo podle při každou každé také jsou bez",
    "hu": "az és hogy nem egy minden után előtt vagy szerint közben érdekében valamint",
    "sw": "na ya wa kwa ni katika za kabla baada ili kila hii ambayo pamoja",
    "hr": "i na se je za od prije kako ili prema svake nakon tijekom bez koji",
    "vi": "và của các để trong với cho được theo trước khi sau mỗi từ những một",
}
_FUNCTION = {lang: frozenset(words.split()) for lang, words in LANGUAGES.items()}

_SPACE = re.compile(r"[\s​‌‍﻿­]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_FINAL = re.compile(r"(?:(?<!\.\.)[.!?]|[。！？؟।])[\s\"”’')\]»]*$")
_CLOSE = re.compile(r"[\s\"”’')\]»]+$")


def is_empty(text: str | None) -> bool:
    """No answer: null, blank, a filler or the text of a failure."""
    if text is None:
        return True
    letters = "".join(c for c in text.lower() if c.isalnum())
    return not letters or letters in FILLERS or bool(_FAILURE.search(text.strip()))


def is_refusal(text: str) -> bool:
    """Whether the response opens with declining."""
    return bool(_REFUSAL.match(text.replace("’", "'").strip()))


def is_foreign(text: str, frequent: Set[str] = frozenset()) -> bool:
    """Not English, by script and function words, or by words beside those of which hardly any is `frequent` in English."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return False
    if sum(c > "ɏ" for c in letters) > 0.3 * len(letters):
        return True
    words = _LETTERS.findall(text.lower())
    hits = {lang: sum(w in f for w in words) for lang, f in _FUNCTION.items()}
    other = max(n for lang, n in hits.items() if lang != "en")
    if other >= 2 and other > 1.5 * hits["en"]:
        return True
    if not frequent or len(words) < FOREIGN_WORDS or hits["en"] > ENGLISH_SHARE * len(words):
        return False
    rest = [w for w in words if w not in _FUNCTION["en"]]
    return sum(w in frequent for w in rest) < KNOWN_SHARE * len(rest)


_PLAINLY = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def copy_cost(prompt: str, response: str) -> tuple[int, int]:
    """(bytes beyond one reference, bytes of the response) with the prompt as dictionary."""
    flat = lambda t: _SPACE.sub(" ", t.lower()).strip().encode()
    a, b = flat(prompt), flat(response)
    if len(a) < 8:
        return len(b), len(b)
    known = zstandard.ZstdCompressionDict(a, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    cost = max(0, len(zstandard.ZstdCompressor(dict_data=known, **_PLAINLY).compress(b)) - ONE_REFERENCE)
    if 1 < cost <= COPY_SHARE * len(b) and b not in a and cost > WITHOUT_SHARE * len(zstandard.ZstdCompressor(**_PLAINLY).compress(b)):
        cost = len(b)  # it is the response that repeats itself, not the prompt
    return cost, len(b)


def last_pair(text: str) -> tuple[str, bool]:
    """(last two words, whether the text ends with a final mark)."""
    words = _WORD.findall(text.lower())[-2:]
    return " ".join(words), bool(_FINAL.search(text))


def judge(prompt: str | None, response: str | None, frequent: Set[str] = frozenset()) -> tuple[str | None, str | None]:
    """(defect, pair to look up): a defect that the pair alone shows, else the word pair in which an unfinished text stops.

    'copy?' stands for a short text that is a copy unless it breaks off.
    """
    if is_empty(response):
        return "empty", None
    if is_refusal(response):
        return "refusal", None
    cost, size = copy_cost(prompt or "", response)
    pair, final = last_pair(response)
    if cost <= COPY_SHARE * size:
        if cost <= 1 or size >= COPY_BYTES or final:
            return "copy", None
        return "copy?", pair
    if is_foreign(response, frequent):
        return "language", None
    return None, None if final else pair


def _judging(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            ids, labels, pairs = [], [], []
            for i, p, r in zip(*(batch.column(c).to_pylist() for c in ("record_id", "prompt", "response")), strict=True):
                label, pair = judge(p, r, frequent)
                if label or pair is not None:
                    ids.append(i)
                    labels.append(label)
                    pairs.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(pairs, pa.string())], names=["record_id", "label", "pair"])

    return look


def _english(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of responses that hold English function words enough, with the number of those responses, summed per batch."""
    for batch in batches:
        held: Counter = Counter()
        for text in batch.column("response").to_pylist():
            words = _LETTERS.findall(text.lower())
            if sum(w in _FUNCTION["en"] for w in words) > ENGLISH_SHARE * len(words) and not is_foreign(text):
                held.update(set(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring words with how often they end a text (with a final mark) and go on, summed per batch."""
    for batch in batches:
        on: Counter = Counter()
        end: Counter = Counter()
        for text in batch.column("response").to_pylist():
            words = _WORD.findall(text.lower())
            on.update(map(" ".join, zip(words[:-2], words[1:-1], strict=True)))
            if len(words) > 1 and _FINAL.search(text):
                end[" ".join(words[-2:])] += 1
        keys = list(on.keys() | end.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([end[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["pair", "ends", "goes"])


def broken_pairs(rows: DataFrame, *, record_id: str, prompt: str, response: str) -> DataFrame:
    """(record_id, defect) of every row whose response is no proper answer to its prompt; one defect a row.

    Null or blank responses are empty; a null prompt can't be copied; a language without a dictionary is told from six
    words on, if there are English responses; texts of any length are judged whole; repeated
    rows each count (and weigh in the model); an empty table gives no rows; other columns are not looked at.
    """
    pairs = rows.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(prompt).alias("prompt"), F.col(response).alias("response"))
    responses = pairs.select("response").where(F.col("response").isNotNull())
    words = responses.mapInArrow(_english, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = frozenset(r.word for r in words.orderBy(F.col("n").desc(), "word").limit(VOCABULARY).collect())
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    judged = pairs.mapInArrow(_judging(shared), "record_id bigint, label string, pair string")
    model = (
        responses.mapInArrow(_contexts, "pair string, ends bigint, goes bigint")
        .groupBy("pair").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    )
    ends = F.coalesce(F.col("ends") / F.nullif(F.col("ends") + F.col("goes"), F.lit(0)), F.lit(0.0))
    broken = F.col("pair").isNotNull() & (ends < END_SHARE)
    defect = F.when(F.col("label") == "copy?", F.when(broken, "truncated").otherwise("copy")).when(F.col("label").isNotNull(), F.col("label")).when(broken, "truncated")
    # Rows without a pair get a key of their own, else they would all meet in the partition of null.
    keyed = judged.withColumn("key", F.coalesce("pair", F.concat(F.lit("\x00"), F.col("record_id").cast("string"))))
    return keyed.join(model.withColumnRenamed("pair", "key"), "key", "left").select("record_id", defect.alias("defect")).where(F.col("defect").isNotNull())
