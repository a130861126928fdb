"""Defects of prompt and payload pairs (problem 3): empty, truncated, refusal, echo, wrong_language.

A suffix automaton of the prompt's words measures how much of the payload is copied from it. Automata of refusals (set
phrases, and templates of who declines, negation and act in any order), delimiter stacks (in the truncation model) and
votes of function words, after the script has decided, find the other defects. Texts are compared in their canonical
form, so disguised characters hide nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import parallel, ship
from . import textform, truncation

DEFECTS = ("empty", "truncated", "refusal", "echo", "wrong_language")

# Fillers that stand for no answer, as words in lower case.
FILLERS = {"n a", "na", "none", "null", "nil", "tbd", "todo", "empty", "no answer", "nan", "undefined", "unknown", "not available", "no response", "blank", "missing", "placeholder", "keine antwort", "aucune réponse", "sin respuesta", "нет ответа"}
# Phrases that decline, and courtesies that may stand beside them.
REFUSALS = (
    "can't help with", "cannot help with", "can not help with", "can't assist", "cannot assist", "not able to assist", "unable to assist", "unable to help", "not able to help",
    "can't be fulfilled", "cannot be fulfilled", "won't be answering", "will not be answering", "can't answer", "cannot answer", "unable to answer", "won't answer", "will not answer",
    "permitted to discuss", "allowed to discuss", "not permitted to", "i am not allowed to", "i'm not allowed to", "must decline", "have to decline", "i decline", "must refuse", "i refuse",
    "have to turn down", "must turn down", "cannot provide information", "can't provide information", "unable to provide", "cannot comply", "can't comply", "against the guidelines", "against my guidelines",
    "have the means to answer", "as a language model", "as an ai", "rather not go into", "rather not discuss", "cannot discuss", "can't discuss", "can't share", "cannot share",
    "kann ich nicht helfen", "nicht weiterhelfen", "muss ich ablehnen", "keine auskunft geben", "darf ich nicht", "kann ich nicht beantworten", "nicht beantworten",
    "ne peux pas répondre", "ne peux pas aider", "ne peux pas vous aider", "ne suis pas autorisé", "préfère décliner", "dois décliner", "dois refuser",
    "no puedo ayudar", "no puedo responder", "debo rechazar", "no tengo permiso", "no estoy autorizado", "tengo que rechazar",
    "не могу помочь", "не могу ответить", "не могу обсуждать", "вынужден отказать", "вынуждена отказать", "должен отказать", "не имею права", "отказаться отвечать", "мне не разрешено", "не могу выполнить",
)
COURTESIES = (
    "sorry", "apologies", "apologize", "is there another topic", "is there anything else", "speak to a qualified", "consult a", "different subject", "thank you for asking", "unfortunately", "regrettably",
    "tut mir leid", "leider", "désolé", "malheureusement", "lo siento", "por desgracia", "lamento", "извините", "к сожалению", "простите",
)
# Of a refusal's template, by language: who declines, negations, modals (a word may be several of these),
# beginnings of the words for what is declined; and words that decline by themselves, beside who does.
TEMPLATES = {
    "en": (
        "i we me us my our", "not can't cannot won't couldn't wouldn't unable don't no isn't aren't never outside beyond against", "can can't cannot could couldn't will won't would wouldn't unable able allow allowed permitted comfortable position going feel rather prefer authorized authorised free something way outside beyond against",
        "help assist answer respond reply provid discuss shar compl fulfil talk advi engag support offer giv comment cover address tell say speak weigh entertain accommodat opinion scope polic guideline rule remit do go subject topic matter question request information detail", "decline refuse",
    ),
    "de": ("ich wir mir uns", "nicht kein keine keinen keinerlei nichts außerhalb", "kann können könnte darf dürfen möchte möchten will werde werden mag außerhalb imstande lage", "helfen weiterhelfen behilflich beantwort antwort auskunft äußern besprech erfüll unterstütz geben diskutier eingehen sagen mitteil sprechen beraten teilen angaben auskünfte informationen stellung thema frage anfrage", "ablehnen verweigern"),
    "fr": ("je j nous", "pas ne n jamais aucun aucune hors impossible", "peux pouvons puis pourrai saurais veux souhaite préfère mesure autorisé autorisée droit hors impossible", "aide répond réponse fournir discut partag parler traiter donner satisf comment assist cadre compétence prononcer conseil renseign information sujet question demande", "refuse refuser refusons décline décliner déclinons"),
    "es": ("puedo podemos poder debo yo me nos soy estoy tengo prefiero voy mi", "no nunca ningún ninguna fuera imposible", "puedo podemos poder posible permitido permite autorizado autorizada condiciones capaz prefiero voy fuera imposible", "ayud respond respuest contest proporcion compart habl discut dar ofrec atender cumpl coment alcance opin inform tema pregunta solicitud", "rechazar rechazo declinar declino negarme"),
    "it": ("posso possiamo devo io mi ci sono preferisco mio", "non mai nessun nessuna fuori impossibile", "posso possiamo grado autorizzato autorizzata permesso preferisco fuori impossibile", "aiut rispond rispost forni discut condivid parl assist dare ambito soddisf comment informazioni argomento domanda richiesta", "rifiutare rifiuto declinare declino"),
    "pt": ("posso podemos devo eu me nos sou estou consigo tenho meu", "não nunca nenhum nenhuma fora impossível", "posso podemos consigo autorizado autorizada permitido capaz fora impossível", "ajud respond respost fornec discut compart fal dar oferec atend assist âmbito coment informaç assunto pergunta pedido", "recusar recuso declinar declino"),
    "nl": ("ik wij we mij ons mijn", "niet geen nooit buiten", "kan kunnen mag mogen wil zal buiten staat", "help beantwoord antwoord bespreken delen geven verstrek bijstaan ingaan voldoen bereik zeggen informatie onderwerp vraag verzoek", "weigeren weiger afwijzen"),
    "ru": ("я мы мне нам могу можем буду моих моей", "не нельзя невозможно вне", "могу можем буду нельзя невозможно вправе право можно вне хочу хотел", "помо отве обсужд предостав дел рассказ выполн коммент давать дать говор подсказ консульт компетенц сказать совет сведени информац тему вопрос запрос", "отказать отказаться отказываюсь отклонить отклоняю"),
    "uk": ("я ми мені нам можу можемо буду", "не неможливо поза", "можу можемо буду неможливо вправі поза", "допом відпов обговор нада діли розпов викон комент говор дати порад інформац тему питання запит", "відмовити відмовитися відмовляюся відхилити"),
    "pl": ("mogę możemy jestem muszę umiem mam moich ja my mi", "nie nigdy poza", "mogę możemy umiem stanie wolno poza", "pomóc pomoc odpowied udziel omawia omówi podać podzieli rozmawia komentow zakres spełni doradz informac temat pytanie prośb", "odmówić odmawiam odrzucić"),
}
# The same for scripts without spaces, as patterns.
UNSPACED = (r"(?:无法|不能|不可以|没办法|不便|無法|不方便)[^。！？]{0,12}(?:回答|帮助|帮忙|提供|协助|讨论|满足|幫助|協助|討論|分享|处理)", r"(?:拒绝|拒絕)(?:回答|提供|协助)", r"(?:お答え|回答|お手伝い|対応|お応え|提供|お話し?)[^。！？]{0,6}(?:でき(?:ません|ない|かねます)|いたしかねます|しかねます|控え)", r"(?:도와|답변|대답|제공|도움)[^.!?]{0,12}(?:수 없|드릴 수 없|어렵)")
# Names of languages, by language.
LANGUAGE_NAMES = {
    "en": ("english", "englisch", "englische", "englischen", "anglais", "anglaise", "inglés", "inglesa", "английский", "английском", "английски", "английского"),
    "de": ("german", "deutsch", "deutsche", "deutschen", "deutscher", "allemand", "allemande", "alemán", "alemana", "немецкий", "немецком", "немецки", "немецкого"),
    "fr": ("french", "französisch", "französische", "französischen", "français", "française", "francés", "francesa", "французский", "французском", "французски", "французского"),
    "es": ("spanish", "spanisch", "spanische", "spanischen", "espagnol", "espagnole", "español", "española", "castellano", "испанский", "испанском", "испански", "испанского"),
    "ru": ("russian", "russisch", "russische", "russischen", "russe", "ruso", "rusa", "русский", "русском", "русски", "русского"),
    "it": ("italian", "italienisch", "italien", "italiano", "italiana", "итальянский", "итальянском"),
    "pt": ("portuguese", "portugiesisch", "portugais", "portugués", "português", "portuguesa", "португальский"),
    "nl": ("dutch", "niederländisch", "néerlandais", "neerlandés", "nederlands", "нидерландский"),
    "pl": ("polish", "polnisch", "polonais", "polaco", "polski", "polsku", "польский", "польском"),
    "uk": ("ukrainian", "ukrainisch", "ukrainien", "ucraniano", "українська", "українською", "украинский", "украинском"),
    "sv": ("swedish", "schwedisch", "suédois", "sueco", "svenska", "шведский"),
    "tr": ("turkish", "türkisch", "turc", "turco", "türkçe", "турецкий"),
    "cs": ("czech", "tschechisch", "tchèque", "checo", "česky", "чешский"),
    "zh": ("chinese", "mandarin", "chinesisch", "chinois", "chino", "中文", "汉语", "китайский"),
    "ja": ("japanese", "japanisch", "japonais", "japonés", "日本語", "японский"),
    "ko": ("korean", "koreanisch", "coréen", "coreano", "한국어", "корейский"),
    "ar": ("arabic", "arabisch", "arabe", "árabe", "العربية", "арабский"),
    "he": ("hebrew", "hebräisch", "hébreu", "hebreo", "עברית"),
    "el": ("greek", "griechisch", "grec", "griego", "ελληνικά", "греческий"),
    "hi": ("hindi", "हिन्दी"),
    "th": ("thai", "ไทย"),
}
# Function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in is it that with for on as by from each has have its when if not be was which how what does do can who where why are or so than this at an you whatever never until one because first".split(),
    "de": "der die das und ist nicht den dem ein eine einen einer von zu mit für auf im wird was wie warum wenn dass auch nach wer welche welcher mir bitte ich kann bei ohne sollte danach deshalb wofür aus oder als über".split(),
    "fr": "le la les des et est une un du de que qui dans pour avec pas sur au il elle ce cette se pourquoi quel quelle ou même mais très trop faut sans depuis puis on car même si avez comment entre".split(),
    "es": "el la los las y es una un de del que en por con para no se al su como qué cuál cómo cuando más está pero también sin esta muy según hacia aunque cada después porque si entre".split(),
    "ru": "и в не на что с по для из от как когда если это его к но уже ещё нет он она они который потому поэтому чем зачем почему около после такой каждый только".split(),
    "uk": "і в не на що з по для із від як коли якщо це його до але вже ще ні він вона вони який тому чому після такий кожен тільки та або є".split(),
    "it": "il lo gli di della dello degli dei che non per con una un nel nella sono come quando perché più anche dopo questo questa ma se da al alla dal cosa".split(),
    "pt": "os as do da dos das que não para com uma um no na em por como quando porque mais também depois este esta mas se ao pelo pela são foi você qual".split(),
    "nl": "de het een van en is niet op te dat die voor met zijn aan er als bij ook wordt naar maar hoe waarom wanneer deze dit door wat kan om".split(),
    "pl": "nie na się że do jest jak co po dla od przez ale czy gdy kiedy który która dlaczego oraz tylko już jeszcze tego ten ta są lub ich".split(),
    "sv": "och att det som en ett är på för med inte av den till har kan när hur varför eller från men om efter vid också ska".split(),
    "tr": "bir ve bu için ile de da ne gibi daha çok ama her nasıl neden değil olarak sonra kadar olan ya en şu ki mi".split(),
    "cs": "na se je že to do jak pro ale nebo když který která proč jen už také aby podle jsou není po při tak".split(),
}
# The language of a script, where it tells, by ranges of its letters; kana decides between the first two.
SCRIPT_LANGUAGES = {"ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff", "ko": "\uac00-\ud7af", "ar": "\u0620-\u06ff", "he": "\u05d0-\u05ea", "el": "\u0370-\u03ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f"}
# Words that ask for a copy when a sentence of the prompt begins with them, and phrases that ask for it anywhere.
COPY_VERBS = "repeat copy quote echo recite wiederhole wiederholen kopiere zitiere répète répétez recopie recopiez copie copiez cite citez repite repita copia copie cita повтори повторите скопируй скопируйте перепиши процитируй".split()
COPY_PHRASES = ("word for word", "verbatim", "wort für wort", "wortwörtlich", "mot pour mot", "mot à mot", "palabra por palabra", "слово в слово", "дословно")

_word = re.compile(r"[^\W_]+")
_sentence = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])|\n+")
_quoted = re.compile(r"[\"“«„][^\"”»“\n]{3,}[\"”»“]")
_literal_asked = re.compile(r"(?i)\b(?:answer|reply|respond|give|print|return|write|output)\b[^.?!\n]{0,30}\bonly\b|\bonly the\b|\bnothing but\b|\bnur (?:den|das|die|mit)\b|\b(?:seulement|uniquement|solo|solamente|únicamente)\b|только")
_language_asked = re.compile("|".join(r"\b" + n + r"\b" if n[0].isalpha() and ord(n[0]) < 0x500 else n for names in LANGUAGE_NAMES.values() for n in names))
_structured = re.compile(r"```|[|{}\[\]]")
_structure = re.compile(r"```.*?(?:```|\Z)|^\s*[|{}\[\]].*$", re.S | re.M)
_apart = re.compile(r"[^\w']+")
_spoken = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_cyrillic, _ukrainian, _russian = re.compile("[\u0400-\u04ff]"), re.compile("[іїєґІЇЄҐ]"), re.compile("[ыэёъЫЭЁЪ]")
_scripts = {lang: re.compile(f"[{r}]") for lang, r in SCRIPT_LANGUAGES.items()}
_any_script = re.compile("[" + "".join(SCRIPT_LANGUAGES.values()) + "]")
_unspaced = re.compile("|".join(UNSPACED))
_template = {lang: (frozenset(who.split()), frozenset(no.split()), frozenset(modal.split()), tuple(acts.split()), frozenset(alone.split())) for lang, (who, no, modal, acts, alone) in TEMPLATES.items()}
_declines = frozenset(w for _, no, _, _, alone in _template.values() for w in no | alone)
MOST_FILLER_WORDS = max(len(f.split()) for f in FILLERS)
_vote: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws):
        _vote.setdefault(_w, []).append(_l)


class SuffixAutomaton:
    """Of a sequence of words: which runs of words occur in it."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            new = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][w]] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._state(self.length[p] + 1, dict(self.next[q]))
                self.link[clone] = self.link[q]
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = clone
                    p = self.link[p]
                self.link[q] = self.link[new] = clone
            last = new

    def _state(self, length: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, words: list[str], least: int = 2) -> list[bool]:
        """Which words belong to a run of at least ``least`` words that the sequence has."""
        out = [False] * len(words)
        at = run = 0
        for i, w in enumerate(words):
            while at and w not in self.next[at]:
                at = self.link[at]
                run = self.length[at]
            if w in self.next[at]:
                at, run = self.next[at][w], run + 1
            if run >= least:
                j = i
                while j > i - run and not out[j]:
                    out[j] = True
                    j -= 1
        return out


@lru_cache(maxsize=2)
def _phrases(before: str = " ") -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("refusal", REFUSALS), ("courtesy", COURTESIES)):
        for p in phrases:
            a.add_word(before + p, kind)
    a.make_automaton()
    return a


def _flat(text: str) -> str:
    return " " + _apart.sub(" ", text.lower().replace("’", "'"))


def is_empty(prompt: str | None, payload: str | None) -> bool:
    """Null, blank, or a filler, unless the prompt asks for just that literal."""
    if payload is None:
        return True
    shown = payload if payload.isascii() else textform.visible(payload)
    if len(list(islice(_word.finditer(shown), MOST_FILLER_WORDS + 1))) > MOST_FILLER_WORDS:
        return False  # more words than any filler has
    shown = textform.by_table(shown).strip()
    if not shown:
        return True
    words = _word.findall(shown.lower())
    if words and " ".join(words) not in FILLERS:
        return bool(len(words) == 1 and shown.startswith("```") and words[0].isalpha() and re.fullmatch(r"```\w*\s*```", shown))
    return not (prompt and _literal_asked.search(prompt) and not _language_asked.search(prompt.lower()))


def declines(sentence: str, window: int = 7) -> bool:
    """Whether a sentence in lower case is a refusal by a template: who, a negation, a modal and an act, or who and a word
    that declines by itself, fewer than ``window`` words from it in any order."""
    if _any_script.search(sentence) and _unspaced.search(sentence):
        return True
    ws = _spoken.findall(sentence)
    if _declines.isdisjoint(ws):
        return False
    stems = [w.split("'")[0] for w in ws]  # i'm, j'ai
    for who, no, modal, acts, alone in _template.values():
        if who.isdisjoint(stems):
            continue
        for k, w in enumerate(ws):
            if w in no or w in alone:
                near = slice(max(0, k - window + 1), k + window)
                if not who.isdisjoint(stems[near]) and (w in alone or not modal.isdisjoint(ws[near]) and any(x.startswith(acts) and x not in no for x in ws[near])):
                    return True
    return False


def is_refusal(payload: str, words: list[str] | None = None) -> bool:
    """Every sentence declines or is a courtesy beside one that does. Declining phrases inside quotes don't count."""
    low = " ".join(payload.lower().replace("’", "'").split())
    spoken = _declines.intersection(_word.findall(low) if words is None else words) or "n't" in low or "cannot" in low
    if not spoken and next(_phrases("").iter(low), None) is None and not (_any_script.search(low) and _unspaced.search(low)):
        return False  # nothing that any refusal has
    text = _quoted.sub(" ", payload)
    refused = False
    for s in _sentence.split(text):
        if s and _word.search(s):
            kinds = {k for _, k in _phrases().iter(_flat(s))}
            if "refusal" in kinds or declines(s.lower().replace("’", "'")):
                refused = True
            elif not kinds:
                return False
    return refused


def is_echo(prompt: str, asked: list[str], given: list[str], least_share: float = 0.6, longest_own: int = 4, whole_run: int = 12) -> bool:
    """The payload is made of runs of the prompt's words: little of its own, and nothing of its own in a row. And it gives
    back half of the prompt at least, or is one run of ``whole_run`` words or more of it."""
    if len(given) < 3 or len(asked) < 3:
        return False
    if sum(map(set(asked).__contains__, given)) < least_share * len(given):
        return False  # even single words don't reach the share
    automaton = SuffixAutomaton(asked)
    got = automaton.covered(given)
    run = worst = 0
    for c in got:
        run = 0 if c else run + 1
        worst = max(worst, run)
    if sum(got) < least_share * len(given) or worst > longest_own:
        return False
    # What is given back of the prompt can't be more than there is in the payload, however often the prompt has it.
    back = min(sum(SuffixAutomaton(given).covered(asked)), sum(got))
    if back < 0.5 * len(asked) and not (len(given) >= whole_run and all(automaton.covered(given, len(given)))):
        return False
    return not asks_copy(prompt)


def asks_copy(prompt: str) -> bool:
    low = prompt.lower()
    if any(p in low for p in COPY_PHRASES):
        return True
    starts = [_word.findall(s)[:2] for s in _sentence.split(low)]
    return any(w in COPY_VERBS for s in starts for w in s[:1] + (s[1:] if s[:1] in (["please"], ["bitte"]) else []))


def languages(text: str, words: list[str] | None = None, least: int = 2) -> frozenset[str]:
    """The languages a text may be in. A script that one language here has decides; Cyrillic by letters that one language
    alone has. Else those with the most function words, if ``least`` at all; several if they have equally many."""
    among = None
    if not text.isascii():
        letters = sum(map(str.isalpha, text))
        for lang, script in _scripts.items() if _any_script.search(text) else ():
            if (n := len(script.findall(text))) and (n > 20 or n * 3 > letters):
                return frozenset([lang])
        if (n := len(_cyrillic.findall(text))) and (n > 20 or n * 3 > letters):
            ukrainian, russian = len(_ukrainian.findall(text)), len(_russian.findall(text))
            if ukrainian != russian:
                return frozenset(["uk" if ukrainian > russian else "ru"])
            among = ("ru", "uk")
    got = Counter(lang for w in filter(_vote.__contains__, _word.findall(text.lower()) if words is None else words) for lang in _vote[w])
    if among:
        most = max(got[lang] for lang in among)
        return frozenset(lang for lang in among if got[lang] == most)
    most = max(got.values(), default=0)
    return frozenset(lang for lang, n in got.items() if n == most) if most >= least else frozenset()


def is_wrong_language(prompt: str, payload: str, asked_words: list[str], given_words: list[str]) -> bool:
    if _structured.search(payload):
        payload = _structure.sub(" ", payload)
        given_words = _word.findall(payload.lower())
    if len(given_words) < 4 and len(_any_script.findall(payload)) < 8:  # scripts without spaces have few words
        return False
    given = languages(payload, given_words)
    if not given:
        return False
    asked = languages(prompt, asked_words)
    if not asked or asked & given:
        return False
    return not any(n in LANGUAGE_NAMES[lang] for n in _language_asked.findall(prompt.lower()) for lang in given)


def defect(prompt: str | None, payload: str | None, cut: bool | None, form: Callable = textform.tries(None).form) -> str | None:
    """The defect of a pair, or None. ``cut``: what the truncation model says of the payload."""
    if is_empty(prompt, payload):
        return "empty"
    p, a = form(prompt) if prompt else "", form(payload)
    asked, given = _word.findall(p.lower()), _word.findall(a.lower())
    echoed = is_echo(p, asked, given)
    if cut and not (echoed and asked[-1] == given[-1]):
        return "truncated"
    if is_refusal(a, given):
        return "refusal"
    if echoed:
        return "echo"
    return "wrong_language" if is_wrong_language(p, a, asked, given) else None


def defects(pairs: DataFrame, row_id: str = "record_id", prompt: str = "prompt", payload: str = "payload", source: str = "local_name", trained: truncation.Trained | None = None, origin: str = "pairs", vocabulary_path: str | None = textform.VOCABULARY) -> DataFrame:
    """(row_id, defect) of each pair that has one; one defect per row, the first of empty, truncated, refusal, echo, wrong_language.

    ``trained`` says what is cut (fitted on these payloads if none is given); ``origin`` is these rows' name in it.
    Rows without an id are left out; exact repeats come out once (of rows with one id and different texts, the
    smallest defect). A null or blank prompt alone is no defect. Other columns don't matter.
    """
    spark = pairs.sparkSession
    ship(spark)
    trained = trained or truncation.train(truncation.values_of(pairs, row_id, source, payload, origin))
    held = spark.sparkContext.broadcast(trained.model)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, form = held.value, textform.tries(vocabulary_path).form
        for b in batches:
            got = []
            for i, p, a, near in zip(b["i"], b["p"], b["a"], b["near"], strict=True):
                if d := defect(p, a, m.is_cut(a, near), form):
                    got.append((i, d))
            yield pd.DataFrame(got, columns=[row_id, "defect"])

    rows = parallel(pairs.select(F.lit(origin).alias("origin"), F.col(row_id).cast("bigint").alias("i"), F.col(source).cast("string").alias("source"), F.col(prompt).alias("p"), F.col(payload).alias("a")).where("i is not null"))
    rows = truncation.near_limit(rows, trained.limits, "a").select("i", "p", "a", "near")
    found = rows.mapInPandas(find, f"`{row_id}` bigint, defect string")
    return found.groupBy(row_id).agg(F.min("defect").alias("defect"))
