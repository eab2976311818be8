"""Fixed tag and rule vocabularies."""

# Tags of the cleaned-HTML contract and of the page decomposition.
CHROME_TAGS = ("nav", "header", "footer", "aside", "form")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "graphic", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
)
RAW_TAGS = ("script", "style")
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "iframe", "li", "main", "nav", "ol", "p", "pre", "section", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
WHITELIST = (
    "h2", "h3", "h4", "p", "ul", "ol", "li", "blockquote", "pre", "code", "table", "thead",
    "tbody", "tr", "th", "td", "strong", "em", "a", "br", "hr", "sup", "sub",
)
TAG_RENAMES = {"h1": "h2", "h5": "h4", "h6": "h4", "b": "strong", "i": "em"}
INLINE_TAGS = ("a", "strong", "em", "b", "i", "code", "br", "sup", "sub", "u")
IMAGE_TAGS = ("img", "graphic")
HEADING_TAGS = ("h1", "h2", "h3")
CONTAINER_TAGS = ("ul", "ol", "blockquote", "pre", "table")
TABLE_TAGS = ("table", "thead", "tbody", "tr", "th", "td")
WRAPPER_TAGS = ("div", "article", "section", "main", "body")
BOILERPLATE_HEADINGS = ("join our email club today!", "news & events")
CTA_ID = "email-cta-heading"

# Containers whose class or id announces something other than the article body.
BOILERPLATE_RULES = (
    ("advert", r"(^|[\s_-])(ad|ads|advert|advertisement|sponsored)($|[\s_-])"),
    ("share", r"(^|[\s_-])(share|sharing|social)($|[\s_-])"),
    ("related", r"(^|[\s_-])(related|recommended)($|[\s_-])"),
    ("author", r"(^|[\s_-])(author|byline|bio)($|[\s_-])"),
    ("newsletter", r"(^|[\s_-])(newsletter|subscribe|signup)($|[\s_-])"),
    ("cookie", r"(^|[\s_-])(cookie|consent|gdpr)($|[\s_-])"),
    ("comments", r"(^|[\s_-])(comment|comments)($|[\s_-])"),
    ("breadcrumb", r"(^|[\s_-])(breadcrumb|breadcrumbs)($|[\s_-])"),
)
BOILERPLATE_CONTAINERS = ("div", "section", "ul", "ol", "p", "span", "aside")

# Elements a person has to look at, and what to call them in the report.
ATTENTION_RULES = (("form", "form"), ("iframe", "embed"), ("video", "video"), ("object", "embed"),
                   ("canvas", "widget"), ("select", "widget"))
# Containers whose class or id announces a part that scripts fill.
ATTENTION_CONTAINERS = ("div", "section", "ul")
ATTENTION_CLASSES = (
    ("slider", r"(^|[\s_-])(slider|carousel|slideshow|swiper|slick)($|[\s_-])"),
    ("map", r"(^|[\s_-])(map|gmap|maps|leaflet|mapbox)($|[\s_-])"),
    ("widget", r"(^|[\s_-])(widget|calculator|booking)($|[\s_-])"),
)
EMBED_PROVIDERS = (
    ("youtube", "video", r"^https?://(www\.)?(youtube\.com|youtube-nocookie\.com|youtu\.be)/"),
    ("vimeo", "video", r"^https?://(www\.|player\.)?vimeo\.com/"),
    ("twitter", "rich", r"^https?://(www\.)?(twitter|x)\.com/"),
    ("instagram", "rich", r"^https?://(www\.)?instagram\.com/"),
    ("facebook", "rich", r"^https?://(www\.)?facebook\.com/"),
)
