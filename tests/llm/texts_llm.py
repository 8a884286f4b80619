import random


def odd_texts():
    rng = random.Random(1)
    out = ["", "a", " ", "  a", "it's we'll they're 'tis I've x''s 's's'd 'D \n\n  'll", "a b 　c", "<|endoftext|>",
           "x <|endoftext|> y<|endoftext|><|endoftext|>", "aaaa" * 900, "=-" * 1000, "\t\t\n  \n x" * 50, " " * 3000 + "x",
           " " * 700, "日本語テキスト" * 30, "١٢٣²½Ⅷ x", "é ́x", "\x00\x1c\x1f a", "🙂🙃 x🙂",
           "a" * 3 + "1" * 700 + "b'" * 300, "▁x ▁▁ y", "</s><unk><0x0A>", "a  b ", "word \x1c word"]
    alphabet = "ab 'stredlvm\n\t1.!é中 🙂́​² "
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1200)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)]))
                    for _ in range(40)) for _ in range(200)]
    return out
