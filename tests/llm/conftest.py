import pytest

#: Texts that try cutting, normalisation and empty input.
ODD = [
    None, "", " ", "  a  b\n\n c\t\td ", "a\n b \n c\n \nd", "x<|endoftext|>y z<|startoftext|> ", "It's we'll I'D 's",
    "naïve ǅ Σας ΣΑΣ 日本語 ½ ² x²", "a\x1cb !\x1c\x1db", "café café ́x", "\n", "a b c　d",
    "İstanbul ŒUVRE ß", "12345 6 78", "___a_b__ --- !?", "😀 👩‍👩‍👧 x\r\ny\r\n\r\n z", "ab <|endoftext|> cd", "x\x00y \x00", "tail \n",
    "﻿bom", "Ḁ̈ ﬁ Å K", "<s> </s> <0x41> <unk>", "▁▁a ▁b", "word " * 5000, "z" * 9000,
]


@pytest.fixture()
def odd(spark):
    """Odd texts with a repeated row, a null id and columns with clashing names."""
    rows = [(i, x, 1, "s") for i, x in enumerate(ODD)]
    rows += [rows[3], (None, "no id", 2, "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, length string")
