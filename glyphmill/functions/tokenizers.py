"""Tokenizers as column functions: string column -> array of tokens, built-in expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, for ASCII folding (fixed values).
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Endings that light stemmers take off, longest first, with what replaces some of them: language -> (least letters of a
#: word, letters that stay at least, endings, replaced endings) (fixed values).
STEMS: dict[str, tuple[int, int, tuple[str, ...], dict[str, str]]] = {
    "danish": (5, 3, ("erne", "ene", "ere", "er", "en", "et", "es", "e", "s"), {}),
    "dutch": (5, 3, ("heden", "eren", "en", "je", "s", "e"), {}),
    "finnish": (6, 3, ("ssa", "ssä", "sta", "stä", "lla", "llä", "lta", "ltä", "lle", "iin", "ien", "jen", "en", "in", "an", "än", "a", "ä", "n", "t"), {}),
    "french": (5, 3, ("issement", "issant", "ement", "ments", "ment", "euses", "euse", "ives", "ées", "ants", "ante", "ant", "ons", "ent", "és", "ée", "er", "ez", "es", "é", "e", "s"), {"ives": "if", "euses": "eux", "euse": "eux"}),
    "german": (5, 3, ("heiten", "keiten", "ungen", "erinnen", "innen", "ern", "ung", "est", "em", "en", "er", "es", "st", "e", "n", "s"), {}),
    "hungarian": (5, 3, ("oknak", "eknek", "ban", "ben", "nak", "nek", "val", "vel", "hoz", "hez", "tól", "től", "ok", "ek", "ak", "at", "et", "ot", "k", "t"), {}),
    "italian": (5, 3, ("azioni", "azione", "amente", "mente", "ando", "endo", "are", "ere", "ire", "ato", "ata", "ati", "ate", "o", "a", "i", "e"), {}),
    "norwegian": (5, 3, ("ene", "ane", "ers", "er", "en", "et", "es", "e", "s"), {}),
    "portuguese": (5, 3, ("amentos", "amento", "mente", "ações", "ação", "ando", "endo", "ar", "er", "ir", "os", "as", "es", "o", "a", "e", "s"), {}),
    "romanian": (5, 3, ("urilor", "elor", "ilor", "ului", "ului", "uri", "ele", "ea", "ul", "ii", "ei", "e", "i", "a"), {}),
    "russian": (5, 3, ("иями", "ями", "ами", "ого", "ему", "ому", "ыми", "ими", "ией", "ах", "ях", "ов", "ев", "ам", "ям", "ом", "ем", "ой", "ей", "ый", "ий", "ая", "яя", "ое", "ее", "ые", "ие", "ы", "и", "а", "я", "о", "е", "у", "ю", "ь"), {}),
    "spanish": (5, 3, ("amientos", "amiento", "aciones", "ación", "mente", "ando", "iendo", "ados", "adas", "ado", "ada", "ar", "er", "ir", "os", "as", "es", "o", "a", "e", "s"), {}),
    "swedish": (5, 3, ("orna", "arna", "erna", "ande", "are", "ar", "er", "or", "en", "et", "na", "a", "e", "s"), {}),
    "turkish": (5, 3, ("lerinden", "larından", "lerin", "ların", "lerde", "larda", "ler", "lar", "den", "dan", "nin", "nın", "de", "da", "in", "ın", "i", "ı"), {}),
}
#: The commonest function words, by language (fixed values).
STOPWORDS: dict[str, tuple[str, ...]] = {
    "danish": ("og", "i", "at", "det", "en", "den", "til", "er", "som", "på", "de", "med", "af", "for", "ikke"), "dutch": ("de", "en", "van", "ik", "te", "dat", "die", "in", "een", "hij", "het", "niet", "is", "op", "aan"),
    "english": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"),
    "finnish": ("ja", "on", "ei", "se", "että", "oli", "mutta", "kun", "niin", "myös", "hän", "ovat"), "french": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "il"),
    "german": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so"), "hungarian": ("a", "az", "és", "hogy", "nem", "is", "egy", "ez", "van", "meg"),
    "italian": ("di", "e", "il", "la", "che", "in", "a", "per", "un", "del", "non", "sono", "una", "con", "le", "i", "si", "da"), "norwegian": ("og", "i", "det", "på", "som", "er", "en", "til", "å", "han", "av", "for", "med", "ikke"),
    "portuguese": ("de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se", "na"), "romanian": ("și", "în", "de", "la", "a", "cu", "nu", "o", "că", "pe", "un", "din"),
    "russian": ("и", "в", "не", "на", "я", "что", "он", "с", "это", "а", "как", "по", "но", "к", "у", "из", "за"), "spanish": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"),
    "swedish": ("och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till", "den", "inte"), "turkish": ("ve", "bir", "bu", "da", "de", "için", "ile", "çok", "ne", "o"),
}
KINDS = (
    "alias", "literal", "literal_normalized", "simple", "whitespace", "unicode_words", "ngram", "regex_pattern",
    "source_code", "chinese_compatible", "lindera", "jieba", "lattice",
)


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer's kind and options, applied in this order: split, lowercase, fold, length, stopwords, stem."""

    kind: str = "simple"
    lowercase: bool = True
    remove_long: int | None = 255
    min_gram: int = 2
    max_gram: int = 3
    prefix_only: bool = False
    pattern: str = r"\w+"
    ascii_folding: bool = False
    stopwords: tuple[str, ...] = field(default=())
    stopwords_language: str | None = None
    stemmer: str | None = None
    mode: str = "c"  # of lattice and lindera: c, b, a (coarse to fine), or search (c, and b where it differs)
    lexicon: tuple[tuple, ...] | None = None  # of lattice, lindera (as lattice.LEXICON) and jieba (word, frequency); each has a small one
    user_lexicon: tuple[tuple, ...] = field(default=())  # entries that go before the lexicon's

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown tokenizer {self.kind!r}; known: {', '.join(KINDS)}")
        if self.stemmer not in (None, "english", *STEMS):
            raise ValueError(f"no stemmer {self.stemmer!r}; known: {', '.join(['english', *STEMS])}")
        if self.stopwords_language is not None and self.stopwords_language not in STOPWORDS:
            raise ValueError(f"no stop words for {self.stopwords_language!r}; known: {', '.join(STOPWORDS)}")
        if self.mode not in ("a", "b", "c", "search"):
            raise ValueError(f"unknown mode {self.mode!r}")

    def all_stopwords(self) -> tuple[str, ...]:
        return (*self.stopwords, *STOPWORDS.get(self.stopwords_language or "", ()))


def ngrams(text: Column, least: int, most: int, prefix_only: bool = False) -> Column:
    """All character n-grams of least to most characters, by length, then place."""
    n = F.char_length(text)

    def of(size: Column) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), F.lit(1) if prefix_only else n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, size))

    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), of))


def source_code(text: Column) -> Column:
    """Words of identifiers: split at anything but letters and digits, and where case or kind changes."""
    spaced = F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def split_words(text: Column, options: Tokenizer) -> Column:
    kind = options.kind
    if kind in ("alias", "literal"):
        return F.array(text.cast("string"))
    if kind == "literal_normalized":
        return F.array(F.lower(F.trim(text)))
    if kind == "simple":
        return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if kind == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    if kind == "unicode_words":
        return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    if kind == "ngram":
        return ngrams(text, options.min_gram, options.max_gram, options.prefix_only)
    if kind == "regex_pattern":
        return F.regexp_extract_all(text, F.lit(options.pattern), F.lit(0))
    if kind == "source_code":
        return source_code(text)
    if kind == "chinese_compatible":
        return F.regexp_extract_all(text, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]|[^\s\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]+"), F.lit(0))
    from glyphmill.functions import lattice

    if kind == "jieba":
        return lattice.frequent_words(text, options.lexicon or lattice.WORD_FREQUENCIES, options.user_lexicon)
    lexicon = lattice.layered(options.lexicon or lattice.LEXICON, options.user_lexicon)
    return lattice.search_surfaces(text, lexicon) if options.mode == "search" else lattice.surfaces(text, options.mode, lexicon)


def stem_english(token: Column) -> Column:
    """A light English stemmer: plural, past and progressive endings of words of five letters and more."""
    long_ = F.char_length(token) >= 5
    out = F.when(long_ & token.endswith("ies"), F.regexp_replace(token, "ies$", "y"))
    out = out.when(long_ & token.endswith("ing"), F.regexp_replace(token, "ing$", ""))
    out = out.when(long_ & token.endswith("ed"), F.regexp_replace(token, "ed$", ""))
    out = out.when(long_ & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", ""))
    return out.otherwise(token)


def stem_light(token: Column, language: str) -> Column:
    """A word without the longest of a language's endings, where enough letters stay."""
    least, stay, endings, replaced = STEMS[language]
    ordered = sorted(dict.fromkeys(endings), key=lambda e: (-len(e), e))
    stemmed = F.regexp_replace(token, f"^(.{{{stay},}}?)(?:{'|'.join(ordered)})$", "$1")
    for ending, new in replaced.items():
        stemmed = F.when(token.rlike(f"^.{{{stay},}}{ending}$"), F.regexp_replace(token, f"{ending}$", new)).otherwise(stemmed)
    return F.when(F.char_length(token) >= least, stemmed).otherwise(token)


def _raw(text: Column, options: Tokenizer) -> tuple[Column, bool]:
    """The split text, and whether it is lower-case already."""
    early = options.lowercase and options.kind in ("simple", "whitespace")  # the same tokens, one call a text
    return split_words(F.lower(text) if early else text, options), early


def _shaped(token: Column, options: Tokenizer, lowered: bool) -> Column:
    """A token after lowercasing and folding."""
    if options.lowercase and not lowered:
        token = F.lower(token)
    if options.ascii_folding:
        token = F.translate(F.regexp_replace(F.regexp_replace(token, "ß", "ss"), "œ", "oe"), FOLD_FROM, FOLD_TO)
    return token


def _kept(token: Column, options: Tokenizer) -> Column | None:
    """Whether a shaped token stays; None if all do."""
    tests = [F.char_length(token) <= options.remove_long] if options.remove_long else []
    if options.all_stopwords():
        tests.append(~token.isin(*options.all_stopwords()))
    return tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else None


def _final(token: Column, options: Tokenizer) -> Column:
    if options.stemmer is None:
        return token
    return stem_english(token) if options.stemmer == "english" else stem_light(token, options.stemmer)


def tokenize(text: Column, options: Tokenizer = Tokenizer()) -> Column:
    """The tokens that remain, in order; null text: an empty array."""
    out, lowered = _raw(text, options)
    if (options.lowercase and not lowered) or options.ascii_folding:
        out = F.transform(out, lambda t: _shaped(t, options, lowered))
    if options.remove_long or options.all_stopwords():
        out = F.filter(out, lambda t: _kept(t, options))
    if options.stemmer:
        out = F.transform(out, lambda t: _final(t, options))
    return F.coalesce(out, F.array().cast("array<string>"))


def exploded(df: DataFrame, text: str, options: Tokenizer = Tokenizer(), token: str = "token") -> DataFrame:
    """df without its text, one row per token: position, token. Options apply to rows, not inside arrays; a token that
    is removed leaves its position empty."""
    out, lowered = _raw(F.col(text), options)
    rows = df.select("*", F.posexplode(out).alias("position", token)).drop(text)
    rows = rows.withColumn(token, _shaped(F.col(token), options, lowered))
    kept = _kept(F.col(token), options)
    rows = rows.where(F.col(token).isNotNull()) if kept is None else rows.where(kept)
    return rows.withColumn(token, _final(F.col(token), options))


def tokenize_table(df: DataFrame, text: str, options: Tokenizer = Tokenizer()) -> DataFrame:
    """df without its text, one row per token: position, token."""
    return exploded(df, text, options)


def tokenizers(spark) -> DataFrame:
    """The names of all kinds."""
    return spark.createDataFrame([(k,) for k in KINDS], "name string")
