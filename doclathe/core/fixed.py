"""Code points, patterns and word lists that results depend on."""

# fixed values
INVISIBLE = (0x00AD, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
BULLETS = (0x2022, 0x00B7, 0x25CF, 0x25CB, 0x25AA, 0x25A0, 0x2023, 0x2043, 0x25E6, 0x2219)
FOLDS = {
    "'": (0x2018, 0x2019, 0x201A, 0x201B, 0x2032, 0x00B4, 0x02BC),
    '"': (0x201C, 0x201D, 0x201E, 0x201F, 0x2033, 0x00AB, 0x00BB),
    "-": (0x2010, 0x2011, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212),
    " ": (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000),
    "x": (0x00D7,),
    "...": (0x2026,),
    "->": (0x2192,),
    "<-": (0x2190,),
    "=>": (0x21D2,),
    "<=": (0x2264,),
    ">=": (0x2265,),
}
LETTERS_PER_TOKEN, DIGITS_PER_TOKEN, MARKS_PER_TOKEN, LONG_SPACE = 5, 3, 4, 96
#: Character ranges of the token estimate.
LETTER = r"A-Za-z\x{C0}-\x{2AF}\x{370}-\x{58F}\x{590}-\x{7FF}"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
SPACE = r" \x{09}-\x{0D}"
ASTRAL = r"\x{10000}-\x{10FFFF}"
IMAGE_EXTENSIONS = "png|jpe?g|gif|svg|webp|bmp|ico|tiff?|avif|heic|heif"
GENERIC_ALT = ("image", "images", "avatar", "photo", "picture", "logo", "icon", "emoji", "img", "thumbnail", "banner", "graphic", "placeholder")
FORMATS = ("docx", "pdf", "pptx", "markdown", "html", "rtf", "text")
#: Presets by field: safe, balanced, aggressive.
PRESETS = {
    "normalize_unicode": (False, True, True),
    "strip_invisible": (True, True, True),
    "ascii_punctuation": (False, True, True),
    "strip_emoji": (False, False, True),
    "tabs_to_spaces": (True, True, True),
    "collapse_spaces": (True, True, True),
    "trim_lines": (True, True, True),
    "max_blank_lines": (2, 1, 0),
    "unwrap": (False, True, True),
    "preserve_code": (True, True, True),
    "strip_markdown": (False, False, True),
    "compact_tables": (False, True, True),
    "unescape_markdown": (False, True, True),
    "strip_media": (True, True, True),
    "transcript": (False, False, False),
}
BASE64_LINE = r"^[ \t]*[A-Za-z0-9+/=]{200,}[ \t]*$"
IMAGE_REF_LINE = rf"(?i)^[ \t]{{0,3}}\[[^\]]+\]:[ \t]*(?:data:\S*|\S+\.(?:{IMAGE_EXTENSIONS}))(?:[ \t]+[\"'(].*)?[ \t]*$"
HEADING_LINE = r"^[ \t]{0,3}#{1,6}(?:[ \t]|$)"
BLOCK_START = r"^(?: {4,}|\t)|^ {0,3}(?:#{1,6}(?:[ \t]|$)|>|\||[-*+][ \t]|[0-9]+[.)][ \t]|`{3,}|~{3,}|<!|</?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))"
MOST_INPUT_BYTES, MOST_PAGES = 100_000_000, 500
# end of fixed values


def char_class(points) -> str:
    """A regular-expression class body for code points (Java and RE2)."""
    return "".join(rf"\x{{{p:X}}}" for p in points)
