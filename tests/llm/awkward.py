"""Rows that operators trip over: nulls, no text, very long texts, copies, repeated rows, and columns with clashing names."""

SHARED = "Some passage that several documents have in common, and that is longer than two hundred bytes, so that it is cut out of every one of them, wherever it stands: at the start, in the middle or at the very end of it all."
COPY = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen.\nA line.\nA line.\n"
LONG = " ".join(f"w{i * 7919 % 5003} x{i}" for i in range(30_000))
EDGE = [
    (None, "a document without an id, mail a.b@c.example.org", "en", "s1"),
    (1, None, "en", "s1"), (2, "", None, None), (3, " \n\t ", "de", "s2"), (4, "word", "en", "s1"), (5, LONG, "en", "s1"),
    (6, COPY, "en", "s2"), (7, COPY, "en", "s3"), (7, COPY, "en", "s3"), (8, COPY.replace("sixteen", "sixteen extra"), "fr", "s1"),
    (9, "start " + SHARED, "en", "s2"), (10, SHARED + " end", "en", None), (11, "x" + SHARED + SHARED, "en", "s1"),
    (12, "Ärger über 日本語 🙂🙂 naïve\x1c\x85　  tail  İstanbul  two", "de", "s1"),
    (13, "Call +1 (743) 555-3824 or 743-555-3824 now; card 4111 1111 1111 1111, ip 10.0.0.256 and 10.1.2.3.4, a@b.c@d.e", "en", "s2"),
    (14, "Licensed under the GNU General Public License.\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH x\nCC-BY cc by", "en", "s2"),
    (15, "!!! ### $$$ *** %%% &&& ||| <<< >>> !!! a b c", "en", "s1"),
    (16, "1234567890" * 2_000 + "." + "@" * 300, "en", "s1"), (17, "A" * 5_000, "en", "s1"), (-5, "negative id", "en", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, token int, place string, packed int, row double, start string, __text string, __body string, __shard string, Body string, shard int, kept_id long, repeated string"
