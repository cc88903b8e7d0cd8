"""Lists, tables and constants that results depend on."""

# Hosts of messengers and social networks; never a company's own site.
MESSENGER_DOMAINS = (
    "vk.com", "vk.link", "vkontakte.ru", "t.me", "telegram.me", "telegram.org", "wa.me", "api.whatsapp.com",
    "ok.ru", "odnoklassniki.ru", "instagram.com", "facebook.com", "youtube.com", "youtu.be",
)

# Platforms whose shared base domain does not make a branch network.
NON_NETWORK_DOMAINS = (
    "vk.com", "vk.link", "vkontakte.ru", "t.me", "telegram.me", "telegram.org", "wa.me", "api.whatsapp.com",
    "ok.ru", "odnoklassniki.ru", "youtube.com", "youtu.be", "yandex.ru", "google.com", "2gis.ru", "avito.ru",
    "instagram.com", "facebook.com", "clients.site", "setup.ru", "wixsite.com", "turbo.site", "business.site",
    "tilda.ws", "ucoz.ru", "1c-umi.ru", "narod.ru", "tb.ru", "orgs.biz", "jcbbscn.com", "taplink.cc",
    "bitrix24site.ru", "tssshop.ru",
)

# Free mail providers.
FREE_EMAIL_DOMAINS = (
    "mail.ru", "inbox.ru", "bk.ru", "list.ru", "yandex.ru", "ya.ru", "gmail.com", "googlemail.com", "hotmail.com",
    "outlook.com", "live.com", "rambler.ru", "yahoo.com", "protonmail.com", "zoho.com", "mail.com",
)

# General directories whose listings are spam; deployments add those of their own trade.
SPAM_DOMAINS = (
    "uslugio.com", "zoon.ru", "jsprav.ru", "yell.ru", "orgpage.ru", "spravka-inform.ru", "2gis.ru", "rting.ru",
    "spravka.ru", "moyaspravka.ru", "damspravku.ru", "spravka-region.ru", "reginforms.ru", "blizko.ru", "2gis.biz",
    "portaluslug.ru", "firmlist.ru", "pulscen.ru", "netoteka.ru", "regionz.ru", "uslugika.ru", "orgzz.ru",
    "openagent.ru", "travelask.ru", "mnogonado.net", "companies.rbc.ru", "vkvideo.ru", "profi.ru", "youla.ru",
    "mapage.ru",
)

# Endings of mail-like strings that are file names.
FAKE_EMAIL_TLDS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "ico", "tif", "tiff", "pdf", "doc", "docx", "xls", "xlsx",
    "ppt", "pptx", "zip", "rar", "7z", "mp4", "avi", "mov", "mp3", "wav", "css", "js", "html", "htm", "xml",
    "woff", "woff2", "ttf", "otf", "eot",
)

# Local parts that are no address.
FAKE_EMAIL_LOCALS = (
    "photo", "image", "icon", "logo", "favicon", "banner", "bg", "background", "thumbnail", "thumb", "avatar",
    "placeholder", "sample", "demo", "test", "example", "email", "username", "user", "admin", "webmaster",
    "postmaster", "noreply", "no-reply", "mailer-daemon", "abuse", "root", "img", "src", "assets", "static",
    "media", "files", "upload", "uploads",
)

# Names of directories that show up as company names.
AGGREGATOR_NAMES = (
    "uslugio", "услугио", "zoon", "зун", "yell", "елл", "jsprav", "pqd", "пкд", "orgpage", "оргпейдж",
    "spravka inform", "справка информ", "2gis", "2гис", "yandex", "яндекс", "google", "гугл", "avito", "авито",
)

# Phrases of advertising titles.
SEO_PHRASES = (
    r"купить|цен[аыуе]|недорог|заказать|от производитель|с установк|на могил|доставк|скидк|каталог"
    r"|памятник[аиы]?\s*(?:из|в|на|от|и)\s+\S|изготовлен.*(?:памятник|надгробие)|памятники\s*(?:в|из|на|и)\s+\S"
    r"|памятники\s*(?:на\s*кладбищ)|изготовление\s*памятников|памятники\s*и\s*надгробия|производство\s*памятников"
    r"|памятниковизгранита|памятникиизгранита|изготовлениепамятников|установкапамятников|памятникинамогилу"
    r"|купитьпамятник|заказатьпамятник"
)
# The shorter list of phrases that the score punishes.
SEO_SCORE_PHRASES = r"купить|цен[аыуе]|недорог|заказать|от производитель|с установк|на могил|доставк|скидк"

# Transliteration, applied in this order.
TRANSLITERATION = (
    ("щ", "shch"), ("ш", "sh"), ("ч", "ch"), ("ж", "zh"), ("ю", "yu"), ("я", "ya"), ("ё", "yo"), ("э", "e"),
    ("х", "kh"), ("ц", "ts"), ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("з", "z"),
    ("и", "i"), ("й", "y"), ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"),
    ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"), ("ъ", ""), ("ы", "y"), ("ь", ""),
)

# Area codes of the two capitals, by the beginning of the city's name.
CAPITAL_CODES = {"москв": ("495", "499", "498"), "санкт-петербург": ("812",), "петербург": ("812",)}

# Substrings of a page that give its system away, in order, and of a generator tag.
CMS_MARKS = (
    ("wordpress", ("wp-content", "wordpress")), ("bitrix", ("bitrix", "1c-bitrix")),
    ("tilda", ("tilda.ws", "tilda.cc", "created on tilda")), ("flexbe", ("flexbe",)), ("lpmotor", ("lpmotor",)),
    ("joomla", ("joomla",)), ("opencart", ("opencart", "route=common/home")),
)
CMS_GENERATORS = (("wordpress", "wordpress"), ("joomla", "joomla"), ("bitrix", "bitrix"), ("tilda", "tilda"), ("modx", "modx"), ("drupal", "drupal"))

# Words in links to contact pages and other useful pages.
CONTACT_TEXTS = ("контакт", "связ", "телефон", "обратн", "написать")
CONTACT_URLS = ("contact", "kontakt", "kontakty", "kontaktyi")
USEFUL_URLS = ("about", "o-nas", "o_kompanii", "production", "proizvodstvo", "catalog", "katalog", "uslugi", "services")

# Funnel stages in order, and the follow-up rule of the open ones.
STAGES = ("new", "email_sent", "email_opened", "tg_sent", "wa_sent", "replied", "interested", "not_interested", "unreachable")
TERMINAL_STAGES = ("replied", "interested", "not_interested", "unreachable")
CADENCE = (
    ("new", 0, "email", "cold_email_v1"), ("email_sent", 4, "tg", "tg_intro"), ("email_opened", 2, "tg", "tg_intro"),
    ("tg_sent", 4, "wa", "wa_intro"), ("wa_sent", 7, "email", "follow_up_email_v1"),
)

# Prepositions and separators in front of a city's name.
CITY_PREPOSITIONS = ("в ", "из ", "для ", "по ", "от ", "до ", "при ", "г. ")
CITY_SEPARATORS = (",", "—", "-", ".", ":")
# Words that mark a street address.
STREET_WORDS = ("ул.", "улица", "проспект", "пр.", "пер.", "д.", "дом", "шоссе", "бульвар")

# Legal forms in front of a name.
LEGAL_FORMS = ("ООО", "ОАО", "ЗАО", "ИП", "АО", "ПАО", "ТОО", "ЧУП", "УП")

#: Words of a profile page that shows the trade.
PROFILE_WORDS = ("ритуал", "похорон", "памятник", "мемориал", "funeral", "angel")
#: Domains whose companies a clean-up deletes.
CLEANUP_DOMAINS = ("acbank.ru", "mvd-kbr.ru", "lotgame.ru", "stroinas.ru", "online-obuchenie.ru", "rosbaltnord.ru", "energogazeta.ru", "help-tel.ru", "2sp.me")
#: Address ranges (first address, prefix length) and hosts that may not be fetched.
PRIVATE_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.51.100.0", 24), ("203.0.113.0", 24),
)
PRIVATE_HOSTS = ("localhost", "metadata", "metadata.google.internal")

#: Elements whose content is no text, tags without content, attributes that only images have.
NOISE_ELEMENTS = ("script", "style", "svg", "noscript")
VOID_TAGS = ("img", "input", "source", "track", "meta", "link", "br", "hr")
IMAGE_ATTRIBUTES = ("data-src", "data-image", "srcset", "data-original")
#: Hosts of messenger links, what their path begins with, and words of links that only share.
MESSENGER_LINKS = {"telegram": (("t.me", "telegram.me"), "/"), "whatsapp": (("wa.me", "api.whatsapp.com"), ""), "vk": (("vk.com", "www.vk.com"), "/")}
SHARING = ("share", "joinchat")
#: File names of images that look like addresses, in general and in stored addresses.
IMAGE_FILES = r"^.+@[0-9]+x|^[a-z]+@[0-9]+x?\."
IMAGE_FILES_STORED = r"^[a-z]+@[0-9]+x?\."
