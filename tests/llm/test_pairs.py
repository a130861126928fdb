import pytest

from promptmill.llm import pairs as P
from promptmill.llm import truncation

ASK = "Why does the plain worker report a narrow width after 58 calls to Pepkag?"
CASES = [
    (ASK, None, "empty"), (ASK, " \u200b", "empty"), (ASK, "N/A", "empty"), (ASK, "...", "empty"), (ASK, "```\n```", "empty"), (ASK, "(no answer)", "empty"),
    ("Which literal does a lookup give for a missing key? Answer with the literal only.", "None", None), ("Reply in German only: what is it?", "-", "empty"), (ASK, "0", None), (ASK, "True", None), (ASK, "No", None),
    (ASK, "I'm sorry, but I can’t help with that.", "refusal"), (ASK, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), (ASK, "К сожалению, я не могу ответить на этот вопрос.", "refusal"),
    (ASK, 'A worker that answers "I can\'t help with that" has lost its index; label it and ask again.', None), (ASK, "Sorry for the delay: it needs 9 seconds before the worker is warm.", None),
    (ASK, "I cannot provide information on X. First rotate the index on Y, then measure whatever it still holds.", None),
    (ASK, ASK, "echo"), (ASK, ASK.upper(), "echo"), (ASK, f"You asked: {ASK}", "echo"), (ASK, ASK.replace("plain ", "").replace("the ", ""), "echo"),
    (ASK, f"You asked: {ASK} Here is the answer. The worker keeps its ledger close to the other one, so its width stays narrow.", None),
    ("Repeat this sentence exactly: The second handle belongs to Cogtor.", "The second handle belongs to Cogtor.", None), ("Copy the next line word for word. Keep 9 grams of flour dry and warm.", "Keep 9 grams of flour dry and warm.", None),
    (ASK, "Der Zähler ist zu groß und wird nicht von dem Knoten benötigt, auch wenn er neu startet.", "wrong_language"), (ASK, "Такой новый сервер подходит для этого, но не для того.", "wrong_language"),
    ("Answer in German. " + ASK, "Der Zähler ist zu groß und wird nicht von dem Knoten benötigt.", None), (None, "Der Zähler ist zu groß und wird nicht benötigt.", None), (" ", "It is the plain one.", None),
    (ASK, "```python\ndef le_la_les(des):\n    return des\n```", None), ("Warum ist der Zähler nicht auf dem Knoten?", "Because the worker is on the other node and it keeps the ledger.", "wrong_language"),
]


@pytest.mark.parametrize(("prompt", "payload", "want"), CASES)
def test_defect(prompt, payload, want):
    assert P.defect(prompt, payload, False) == want


def test_disguised_prompt_is_seen_through(vocabulary):
    from promptmill.llm import textform

    form = textform.tries(vocabulary).form
    assert P.defect("Wһу ԁоеѕ tһе рlаіn wоrkеr rероrt а wіԁtһ?", "Why does the plain worker report a width?", False, form) == "echo"


def test_truncated_comes_before_the_rest_but_not_before_a_whole_echo():
    assert P.defect(ASK, "It keeps the ledger close and the", True) == "truncated"
    assert P.defect("Give me ideas for a day at the mill near Cyrlis", "Give me ideas for a day at the mill near Cyrlis", True) == "echo"


def brute_cover(asked, given, least):
    runs = {tuple(asked[i:j]) for i in range(len(asked)) for j in range(i + least, len(asked) + 1)}
    out = [False] * len(given)
    for i in range(len(given)):
        for j in range(i + least, len(given) + 1):
            if tuple(given[i:j]) in runs:
                out[i:j] = [True] * (j - i)
    return out


def test_suffix_automaton_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        for least in (1, 2, 3):
            assert P.SuffixAutomaton(a).covered(b, least) == brute_cover(a, b, least)


def test_long_texts_do_not_fail():
    long = "the plain worker keeps its ledger " * 20_000
    assert P.defect(long, long, False) == "echo"
    assert P.defect(ASK, "It is the answer of the worker. " * 20_000, False) is None


def test_defects_of_a_table(spark, vocabulary):
    rows = [(1, ASK, None, "s", 0), (1, ASK, None, "s", 0), (2, ASK, "It is narrow because it is measured slowly.", None, 0), (3, None, "fine.", "s", 0), (None, ASK, "", "s", 0), (4, ASK, ASK, "s", 0)]
    df = spark.createDataFrame(rows, "record_id bigint, prompt string, payload string, local_name string, defect int")
    counts = truncation.statistics(truncation.values_of(df, "record_id", "local_name", "payload", "pairs"), 1)
    trained = truncation.Trained(truncation.fit([truncation.Sample("It is whole. It is done.")] * 30, frozenset()), truncation.source_limits(counts))
    got = P.defects(df, trained=trained, vocabulary_path=vocabulary)
    assert sorted(map(tuple, got.collect())) == [(1, "empty"), (4, "echo")]
    assert P.defects(df.where("false"), vocabulary_path=vocabulary).count() == 0


# Wordings that were looked at while the templates were made: of the first 26, before they were used for that, 22 were found.
SEEN_REFUSALS = [
    "I'm sorry, but I'm not able to go into that subject.", "This is beyond what I can help you with.", "I won't respond to questions of this kind.", "We cannot comment on individual cases.", "I'd prefer not to give an opinion on that.",
    "I am not permitted to share internal details.", "Apologies, I don't feel able to advise on this.", "That request is outside our scope.", "I must refuse to answer.", "I'm unable to tell you that.",
    "Leider kann ich dir dabei nicht behilflich sein.", "Dazu darf ich keine Angaben machen.", "Ich möchte mich dazu nicht äußern.", "Malheureusement, je ne peux pas traiter cette question.", "Nous ne sommes pas en mesure de vous conseiller.",
    "Lamento no poder ayudarte con esta solicitud.", "No me es posible comentar ese tema.", "К сожалению, я не вправе это обсуждать.", "Простите, мы не можем предоставить такие сведения.", "Mi dispiace, non sono in grado di rispondere.",
    "Infelizmente não posso comentar esse assunto.", "Niestety nie mogę udzielić takiej informacji.", "На жаль, я не можу вам допомогти.", "很抱歉，我不能讨论这个话题。", "恐れ入りますが、その件には対応いたしかねます。", "Helaas kan ik daar geen antwoord op geven.",
]
# Wordings that weren't: they are only measured.
HELD_OUT_REFUSALS = [
    "Sorry, I can't get into that.", "I'm afraid that's a topic I can't cover.", "We don't offer guidance on this.", "I'm not going to engage with that question.", "It would be better if I didn't say anything about this.",
    "That's something I am not authorised to discuss.", "I will not provide a response to this request.", "My rules don't allow me to answer.", "Da kann ich leider nicht weiterhelfen.", "Ich bin nicht befugt, darüber zu sprechen.",
    "Diese Frage möchte ich lieber nicht beantworten.", "Je regrette, je n'ai pas le droit d'en parler.", "Je ne souhaite pas répondre à cela.", "Prefiero no hablar de ese asunto.", "Me temo que no puedo darte esa información.",
    "Я не хотел бы отвечать на этот вопрос.", "Увы, я не могу дать совет по этой теме.", "Purtroppo non mi è permesso parlarne.", "Lamento, mas não me é permitido responder.", "Nie jestem w stanie odpowiedzieć na to pytanie.", "对不起，这个问题我无法提供帮助。", "申し訳ございませんが、お手伝いできません。",
]
ANSWERS = [
    "It cannot provide more than five handles.", "The worker does not answer while it is warm.", "We measure it twice, because the index is not stable.", "I keep the ledger close, so no handle is lost.", "No, my worker is narrow.",
    "Der Knoten kann nicht antworten, wenn er voll ist.", "Ich messe nicht zweimal.", "Le serveur ne répond pas après trois appels.", "El servidor no responde después de tres llamadas.", "Сервер не отвечает на вызовы.",
    "I would not use the narrow one; take the wide one instead.", "Il server non risponde.", "服务器无法启动，因为磁盘已满。", "Not with this version.", "Nie działa.", "I have not seen it help; the index stays cold.",
    "My advice: do not open the second one.", "You may not enter before nine.", "O servidor não fecha a janela.", "I'm sorry for the delay. The worker is warm now.",
]


def test_refusals():
    assert all(map(P.is_refusal, SEEN_REFUSALS))
    found = [t for t in HELD_OUT_REFUSALS if P.is_refusal(t)]
    assert len(found) >= 0.8 * len(HELD_OUT_REFUSALS), set(HELD_OUT_REFUSALS) - set(found)
    assert not [t for t in ANSWERS if P.is_refusal(t)]


@pytest.mark.parametrize(
    ("prompt", "payload", "want"),
    [
        (ASK, "工作者的索引太窄，所以每次调用都会变慢。", "wrong_language"), (ASK, "インデックスが狭いため、呼び出しのたびに遅くなります。", "wrong_language"), (ASK, "Il contatore è troppo grande perché il nodo non è più vuoto.", "wrong_language"),
        (ASK, "O contador não está vazio porque os nós são mais lentos do que antes.", "wrong_language"), (ASK, "Лічильник завеликий, тому що він ще не порожній і його вже ніхто не читає.", "wrong_language"),
        (ASK, "Licznik jest za duży, ponieważ nie jest jeszcze pusty i się nie zmienia.", "wrong_language"), ("Чому лічильник ще не порожній і хто його читає?", "Счётчик слишком большой, потому что он ещё не пустой, и его никто не читает.", "wrong_language"),
        ("Чому лічильник ще не порожній?", "Лічильник завеликий, тому що його ще ніхто не читає.", None), ("索引为什么这么窄？", "因为工作者每次只读取一个段。", None), ("Perché il contatore non è vuoto?", "Perché il nodo della coda non è più fermo.", None),
        ("Answer in Chinese: " + ASK, "工作者的索引太窄，所以每次调用都会变慢。", None), (ASK, "func a(v []int) int {\n    for _, v := range v {\n        v += v\n    }\n}", None),
    ],
)
def test_more_languages(prompt, payload, want):
    assert P.defect(prompt, payload, False) == want


def test_echo_is_decided_by_coverage():
    long = "The plain worker keeps its ledger close to the other one. " + ASK + " Visitors reach the mill by the old road behind the narrow garden, and nobody counts the steps."
    assert P.defect(long, ASK, False) == "echo"  # one run of twelve words or more, though the prompt is longer
    assert P.defect(long, "the plain worker keeps its ledger", False) is None
    assert P.defect(ASK, "​" * 90 + "N/A", False) == "empty"
