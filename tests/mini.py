"""A small model: the pieces of the golden texts, closed over single characters."""

from tessera.operators.kernel import Pieces, Tokenizer
from tessera.sources.vocab import SpecialTokens, Vocab

# Ids of the pieces in the known encodings.
PIECES = {
    6: "▁", 7: "s", 10: "▁a", 38: "!", 47: "▁to", 83: "▁is", 153: "▁...", 170: "j", 186: "▁be", 214: "ing", 345: "▁U",
    705: "▁?", 903: "▁this", 1098: "ken", 1221: "▁will", 1274: "▁hi", 2046: "▁get", 2746: "én", 3293: "▁This",
    3309: "▁́", 3608: "▁Š", 3642: "▁how", 5675: "▁th", 11016: "gl", 25636: "▁tok", 29367: "ized", 36277: "šić",
    39973: "▁dấu", 52908: "œ", 55315: "▁nặng", 63770: "▁İs", 76648: "▁Wonder", 121413: "▁sample", 149357: "▁sentence",
    243691: "🤔",
}


def tokenizer(**options) -> Tokenizer:
    chars = sorted({c for p in PIECES.values() for c in p} - set(PIECES.values()))
    values = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3} | {t: i for i, t in PIECES.items()}
    values |= {c: 300000 + i for i, c in enumerate(chars)} | {"<mask>": 400000}
    scored = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0)] + [(t, -4.0 if t == "▁" else -1.0) for t in PIECES.values()] + [(c, -20.0) for c in chars]
    specials = SpecialTokens(unk="<unk>", pad="<pad>", bos="<s>", sep="</s>", cls="<s>", eos="</s>", mask="<mask>")
    return Tokenizer(Vocab(values, specials), Pieces(scored), **options)
