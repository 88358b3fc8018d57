"""Profiles of language-dependent patterns and the parameters of a graph build."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The marker patterns, stems, forms and seed terms of the cyrillic profile.
CONTRAST_CYRILLIC = (
    r"\bне\s+.{1,40}\s*,?\s*а\s+",
    r"\bв\s+отличие\s+от\b",
    r"\bв\s+противоположность\b",
    r"\bоднако\b",
    r"\bзато\b",
    r"\b—\s*это\s+вам\s+не\b",
    r"\bвместо\s+(истины|правды|факта)\b",
    r"\bподмен(ить|яет|яют|яя)\s+понятие\b",
    r"\bне\s+(правда|истина|факт)\s*,?\s*а\s+(ложь|обман|фальш|иллюзи)",
    r"\b(ложь|обман|фальш)\s+вместо\s+(правды|истины)\b",
    r"\bпротивопоставл(ение|яет|яют)\b",
    r"\bв\s+то\s+время\s+как\b",
)
PRONOUNS_CYRILLIC = (
    "он", "она", "оно", "они", "его", "её", "их", "этот", "эта", "это", "эти", "такой", "такая", "такое", "данный", "данная",
)
AFFECT_CYRILLIC = (
    "важн", "критич", "успех", "прорыв", "кризис", "проблем", "поддерж", "автоном", "риск", "лидер", "отстав", "провал",
    "достижен", "перспектив", "угроз", "обман", "манипул", "фальш", "лжив", "достоверн", "честн", "скрыт", "иллюзи",
    "мифологи", "заблужден", "релятивизм", "постправд", "искажен", "дезинформ", "пропаганд", "абсолютн", "справедлив",
)
SEEDS_CYRILLIC = (
    "истина", "правда", "ложь", "обман", "заблуждение", "релятивизм", "пропаганда", "просвещение", "манипуляция", "постправда",
    "справедливость", "свобода", "власть", "идеология", "наука", "вера", "бог", "миф", "страх", "сомнение", "познание",
    "реальность", "факт", "смысл", "добро", "зло", "нация", "национальный", "запад", "европа", "честность", "иллюзия", "абсурд",
    "дезинформация", "достоверность",
)
CORE_CONCEPTS_CYRILLIC = ("истина", "ложь", "правда", "обман", "заблуждение")

#: Function words of three letters or more, by kind; a longer list is a parameter (sources.read_terms).
FUNCTION_WORDS_CYRILLIC = tuple((
    # conjunctions and particles
    "что как или если чтобы когда пока хотя либо тоже также ведь вот даже лишь уже еще ещё только именно разве пусть будто словно"
    # prepositions
    " для при про под над без через между перед после около против вместо среди кроме ради из-за из-под"
    # pronouns and demonstratives
    " она оно они его её нее неё ему ней ним ними них вас вам нас нам мне меня тебя себя свой своя свое своё свои мой твой наш ваш"
    " этот эта это эти этого этой этом этих тот той тех тем том такой такая такое такие кто который которая которое которые чей весь все всё всех всем"
    # adverbs of place, time and degree, and auxiliary verbs
    " где там тут здесь куда туда так очень более менее есть был была было были быть будет будут может можно надо нужно нет"
).split())


@dataclass(frozen=True)
class Profile:
    """What depends on the language: ``token`` is matched on lower-cased text.

    Stop words are a parameter (a long list belongs in a file: see sources.read_terms).
    Patterns are Java regular expressions; word bounds are Unicode-aware by (?U).
    """

    name: str
    token: str
    contrast: tuple[str, ...] = ()
    pronouns: tuple[str, ...] = ()
    affect: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    core_concepts: tuple[str, ...] = ()
    #: A functions.text.Lexicon; without one, tokens stand for themselves and all words count as content.
    lexicon: object | None = None

    @property
    def contrast_pattern(self) -> str:
        return "(?iuUd)" + "|".join(f"(?:{p})" for p in self.contrast)

    @property
    def pronoun_pattern(self) -> str:
        return r"(?iuU)\b(" + "|".join(self.pronouns) + r")\b"

    @property
    def affect_pattern(self) -> str:
        return "|".join(self.affect)


CYRILLIC = Profile(
    "cyrillic", r"[а-яё][а-яё\-]{2,}", CONTRAST_CYRILLIC, PRONOUNS_CYRILLIC, AFFECT_CYRILLIC, SEEDS_CYRILLIC, FUNCTION_WORDS_CYRILLIC,
    core_concepts=CORE_CONCEPTS_CYRILLIC,
)
#: Any alphabet, with marker words that occur in invented European prose.
UNICODE = Profile(
    "unicode", r"\p{L}[\p{L}\-]{2,}", (r"\bfrom\b", r"\bwith\b"), ("he", "she", "it", "they", "this", "that", "these"), ("tion", "ble"),
    ("inter", "ment", "heit", "oner"), ("the", "and", "der", "die", "und", "les", "des", "que", "los", "las", "una", "est"),
    core_concepts=("this", "that", "was", "are", "for"),
)


@dataclass(frozen=True)
class BuildConfig:
    """Parameters of a build; the presets below are those of the two published corpora."""

    profile: Profile = CYRILLIC
    vertex_methods: tuple[str, ...] = ("ner", "yake", "tfidf")
    edge_methods: tuple[str, ...] = ("cooccurrence", "rhetorical", "emotional")
    max_vertices: int = 400
    min_vertex_score: float = 0.0
    level: str = "sentence"
    window: int = 3
    min_weight: int = 2
    min_pmi: float = 5.0
    backbone_k: int = 0
    stress_fraction: float = 0.2
    stress_seeds: int = 5
    stress_threshold: float = 0.6
    seed: int = 42


TRUTH_CORPUS = BuildConfig(
    vertex_methods=("docfreq", "yake"), edge_methods=("cooccurrence", "rhetorical", "emotional", "perplexity"), max_vertices=110,
    min_pmi=-10.0, backbone_k=10, stress_threshold=0.5,
)
SCIENCE_CITIES = BuildConfig(
    vertex_methods=("ner", "yake", "tfidf", "textrank", "paraphrase_cluster"), edge_methods=("cooccurrence", "anaphora", "rhetorical", "emotional", "perplexity"),
)
TESTDATA = replace(TRUTH_CORPUS, profile=UNICODE, vertex_methods=("docfreq",))
