"""Language of a text from its function words, for the five languages of the corpora."""

from __future__ import annotations

import re

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with be by this are or from at an not which have was you can who each must if when there their has its but also will they on about after before while may our your what how where he she we us my do does did so than then these those into only more most other such any all no nor neither because between during under over out up".split(),
    "es": "el la los las de del que y en un una por con para es se no lo al su sus como más pero este esta estos estas cuando muy sin sobre entre hay donde quien desde todo todos también fue era ser si porque según hasta antes después cada qué cuánto dónde quién cuándo cuál usted le les yo ya".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur avec est sont au aux ce cette ces il elle ne pas plus se son sa ses ou où mais comme sans sous après avant être avoir leur leurs nous vous je tu selon lorsque puisque afin chaque quel quelle combien quand".split(),
    "de": "der die das den dem des und in zu mit von für auf ist im nicht ein eine einen einem einer eines als auch es an werden aus er sie nach bei um am sind noch wie über so zum zur hat nur oder aber vor bis durch man wird sich wenn da damit weil was wer wo wann welche diese dieser dieses ohne gegen unter".split(),
    "pt": "o a os as de do da dos das que e em um uma para por com não no na nos nas se é ao aos mais como mas foi ser são seu sua seus suas ou quando muito já também só pelo pela até isso ela ele entre depois sem mesmo antes conforme porque sobre este esta cada qual quanto onde quem".split(),
}
WORD = re.compile(r"[^\W_]+")
OF_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        OF_WORD.setdefault(_w, []).append(_lang)
WEIGHT = {w: 1.0 / len(langs) for w, langs in OF_WORD.items()}
DIACRITICS = {"es": "ñ¿¡", "fr": "çœêèëûîù", "de": "äöüß", "pt": "ãõ"}


def scores(text: str) -> tuple[dict[str, float], int]:
    """Weighted hits of each language's function words, and the number of words."""
    words = WORD.findall(text.lower())
    out = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        for lang in OF_WORD.get(w, ()):
            out[lang] += WEIGHT[w]
    if not text.isascii():
        for lang, marks in DIACRITICS.items():
            out[lang] += 0.5 * sum(text.count(m) for m in marks)
    return out, len(words)


def language(text: str | None, least: float = 1.0, margin: float = 1.3) -> str:
    """The text's language, or "und" where the evidence is short or split.

    The winner needs a score of `least` and `margin` times the second; a text of no function words is "und".
    """
    if not text:
        return "und"
    found, _ = scores(text)
    (best, a), (_, b) = sorted(found.items(), key=lambda x: -x[1])[:2]
    return best if a >= least and a >= margin * b else "und"
