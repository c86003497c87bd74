"""Word lists and patterns used by the rule stages.

FIXED VALUES. Everything in this module is a value that must equal the
annotation conventions it reproduces (label names, trigger words, shapes,
gazetteers).  The lists are kept in their natural order and spelling; a few
entries hold upper-case letters although they are compared against
lower-cased text -- those entries can never match unless ``compat=False``.
"""

# --------------------------------------------------------------------------
# FIXED VALUES: pattern ruler
# --------------------------------------------------------------------------

CAR_MAKES = [
    "audi", "baic", "bmw", "changan", "chery", "chevrolet", "chrysler", "citroen", "dodge", "ds",
    "ferrari", "fiat", "ford", "foton", "geely", "haval", "heibao", "honda", "hyundai", "isuzu",
    "jac", "jaguar", "jeep", "kia", "lexus", "lifan", "maserati", "mclaren", "mini", "mitsubishi",
    "nissan", "peugeot", "porsche", "ram", "renault", "saab", "seat", "shineray", "smart", "soueast",
    "ssangyong", "subaru", "suzuki", "swm", "toyota", "volkswagen", "volvo",
]
CAR_MAKES_TWO_WORDS = ["alfa romeo", "mercedes benz", "land rover", "great wall"]

# Bank names, one phrase per bank, tokens separated by single spaces.
# Notation: "-?" optional hyphen token, "(?" / ")?" optional parentheses,
# "<p>?" an optional punctuation token.
BANKS = [
    "banco columbia",
    "nuevo banco bisel",
    "nuevo banco de entre ríos",
    "icbc argentina",
    "citibank",
    "banco masventas",
    "rci Banque",
    "a.b.n. amro bank",
    "bbva banco francés",
    "bank of america national association",
    "bnp paribas",
    "the bank of tokyo -? mitsubishi Ufj <p>? ltd <p>?",
    "banco b <p>? i <p>? creditanstalt",
    "hsbc Bank argentina",
    "j p Morgan Chase bank national association (? sucursal buenos Aires )?",
    "american express bank ltd",
    "M.B.A. banco de inversiones",
    "deutsche bank",
    "bacs banco de credito y securitizacion",
    "banco de galicia y buenos aires",
    "banco de la nación argentina",
    "banco de la provincia de buenos aires",
    "banco de la provincia de cordoba",
    "banco supervielle",
    "banco de la ciudad de buenos aires",
    "banco patagonia",
    "banco hipotecario",
    "banco de san juan",
    "banco do brasil",
    "banco del tucuman",
    "banco municipal de rosario",
    "banco santander rio",
    "banco regional de cuyo",
    "banco del chubut",
    "banco de Santa cruz",
    "banco de la pampa sociedad de economía mixta",
    "banco de corrientes",
    "banco provincia del neuquén",
    "banco credicoop cooperativo limitado",
    "banco de valores",
    "banco roela",
    "banco mariva",
    "banco itau buen ayre",
    "banco provincia de tierra del fuego",
    "banco de la republica oriental del uruguay",
    "banco saenz",
    "banco meridian",
    "banco macro",
    "banco mercurio",
    "banco comafi",
    "banco de inversion y comercio exterior",
    "banco piano",
    "banco finansur",
    "banco julio",
    "banco privado de inversiones",
    "nuevo banco de la rioja",
    "banco del sol",
    "nuevo banco del chaco",
    "banco de formosa",
    "banco cmf",
    "banco de santiago del estero",
    "nuevo banco industrial de azul",
    "nuevo banco de santa fe",
    "banco cetelem argentina",
    "banco de servicios financieros",
    "banco cofidis",
    "banco bradesco argentina",
    "banco de servicios y transacciones",
]

# Licence-plate shapes (the four holding a space can never match one token).
PLATE_SHAPES = [
    "XXX ddd", "XXX-ddd", "XXXddd", "ddd XXX", "ddd-XXX", "dddXXX", "XX-ddd-XX", "XXdddXX",
    "xxx ddd", "xxx-ddd", "xxxddd", "ddd xxx", "ddd-xxx", "dddxxx", "xx-ddd-xx", "xxdddxx",
]

IP_REGEX = r"^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}$"

STUDY_LEVELS = ["secundarios", "primarios", "terciarios", "universitarios"]
STUDY_STATES = ["completos", "incompletos"]

DNI_SHAPES = ["d.ddd.ddd", "dd.ddd.ddd", "ddd.ddd.ddd"]
PHONE_SHAPES = ["dd-dddd-dddd", "dddddddddd", "dddd-dddd", "dddd-ddd-dddd"]
IP_SHAPES = ["ddd.ddd.ddd.ddd", "ddd.dd.ddd.d", "ddd.dd.ddd.dd"]
NUMERIC_DATE_SHAPES = ["dd/dd/dd", "dd/dd/dddd", "d/d/dd", "d/d/dddd", "d/dd/dddd"]

CUIJ_PREFIXES = ["CAU", "ICN", "IPP"]

MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

NATIONALITIES = [
    "argentino", "boliviano", "paraguayo", "colombiano", "chileno", "brasileño", "panameño",
    "italiano", "español", "mexicano", "ruso", "francés", "inglés", "venezolano", "estadounidense",
    "alemán", "chino", "indio", "cubano", "nigeriano", "polaco", "sueco", "turco", "japonés",
    "portugués", "iraní", "paquistaní", "costarricense", "canadiense", "marroquí", "griego",
    "egipcio", "coreano", "ecuatoriano", "peruano", "guatemalteco", "salvadoreño", "holandés",
    "dominicano",
]

CUIT_REGEX = r"^(20|23|27|30|33)([0-9]{9}|-[0-9]{8}-[0-9]{1})$"
FILE_EXTENSIONS = [
    "jpg", "png", "gif", "bmp", "tiff", "svg", "doc", "docx", "odt", "txt", "pdf", "mp3", "avi",
    "mp4", "mkv", "mpg", "mpeg", "mov", "asf", "webm", "3gp", "3g2", "m4v",
]
PASSPORT_REGEX = r"^([a-zA-Z]{3}[0-9]{6})$"

# Tag groups of the ruler, in pattern order.
RULER_GROUP_TAGS = [
    ("dni", ["argentina", "juzgado10"]),
    ("telefonos", ["argentina", "juzgado10"]),
    ("ips", ["internet", "juzgado10"]),
    ("fecha_numerica", ["español", "juzgado10"]),
    ("cuij", ["judicial", "juzgado10"]),
    ("fecha", ["español", "juzgado10"]),
    ("nacionalidad", ["español", "juzgado10"]),
    ("bancos", ["argentina", "juzgado10"]),
    ("patentes", ["argentina", "juzgado10"]),
    ("estudios", ["argentina", "juzgado10"]),
    ("marcas_autos", ["argentina", "juzgado10"]),
    ("correo_electronico", ["internet", "juzgado10"]),
    ("ley", ["judicial", "juzgado10"]),
    ("cuit", ["argentina", "juzgado10"]),
    ("archivos", ["internet", "juzgado10"]),
    ("pasaporte", ["argentina", "juzgado10"]),
    ("link", ["internet", "juzgado10"]),
    ("cbu", ["argentina", "juzgado10"]),
    ("usuarix", ["internet", "juzgado10"]),
]

# --------------------------------------------------------------------------
# FIXED VALUES: number matcher and sequence matchers
# --------------------------------------------------------------------------

# Spanish number words of the base language data ...
BASE_NUM_WORDS = [
    "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez",
    "once", "doce", "trece", "catorce", "quince", "dieciséis", "diecisiete", "dieciocho",
    "diecinueve", "veinte", "veintiuno", "veintidós", "veintitrés", "veinticuatro", "veinticinco",
    "veintiséis", "veintisiete", "veintiocho", "veintinueve", "treinta", "cuarenta", "cincuenta",
    "sesenta", "setenta", "ochenta", "noventa", "cien", "mil", "millón", "billón", "trillón",
]
# ... extended with these words.
EXTRA_NUM_WORDS = [
    "ciento", "docientas", "docientos", "doscientas", "doscientos", "trecientas", "trecientos",
    "trescientas", "trescientos", "cuatrocientas", "cuatrocientos", "quinientas", "quinientos",
    "seiscientas", "seiscientos", "setecientas", "setecientos", "ochocientas", "ochocientos",
    "novecientas", "novecientos", "millones", "billones", "trillones",
]
NUM_WORDS = BASE_NUM_WORDS + EXTRA_NUM_WORDS

PAGE_FIRST_LEFT = ["página", "pag", "p", "p.", "pág", "pág.", "fs", "inciso", "inc"]
PAGE_SECOND_LEFT = ["página", "pag", "fs", "inciso", "inc"]
MEASURE_FIRST_RIGHT = ["inc", "metros", "m", "gr", "grs", "gramos", "km", "kg", "cm"]

ARTICLE_WORDS = ["artículo", "articulo", "artículos", "articulos", "art", "arts"]

VIOLENCE_WORDS = ["violencia", "violencias"]
VIOLENCE_TYPES = [
    "ambiental", "doméstica", "domestica", "económica", "economica", "física", "fisica",
    "patrimonial", "psicológica", "psicologica", "sexual", "simbólica", "simbolica", "social",
]
GENDER_VIOLENCE_TYPES = ["género", "genero"]

LABEL_GENDER_VIOLENCE = "CONTEXTO_VIOLENCIA_DE_GÉNERO"
LABEL_VIOLENCE = "CONTEXTO_VIOLENCIA"

# Callback tags of the sequence matchers.
MATCHER_CALLBACK_TAGS = [("articulos", ["judicial"]), ("violencia", ["judicial"])]

# --------------------------------------------------------------------------
# FIXED VALUES: contextual rules
# --------------------------------------------------------------------------

PERIOD_WORDS = [
    "segundo", "segundos", "minuto", "minutos", "hr", "hs", "hora", "horas", "año", "años",
    "dia", "día", "dias", "días", "mes", "meses",
]
LAW_LEFT = ["ley", "leyes"]
ADDRESS_FIRST_LEFT = [
    "calle", "Calle", "dirección", "Dirección", "avenida", "av.", "Avenida", "Av.", "pasaje",
    "Pasaje", "Parcela", "parcela",
]
ADDRESS_SECOND_LEFT = [
    "instalación", "contramano", "sita", "sitas", "sito", "sitos", "real", "domiciliado",
    "domiciliada", "constituido", "constituida", "contramano", "intersección", "domicilio",
    "ubicado", "registrado", "ubicada", "real",
]
ADDRESS_CONNECTOR = "en"
PLATE_LEFT = ["patente", "dominio"]
PLACE_LEFT = ["asentamiento", "paraje", "localidad", "country", "distrito"]

AGE_RIGHT = "años"
AGE_SENTENCE_WORD = "edad"
NUMBER_ABBREV = "nº"
CASE_FIRST_LEFT = "caso"
CASE_SECOND_LEFT = "causa"
CUIJ_WORD = "cuij"
ACTUACION_NUMBER_WORD = "nro"
ACTUACION_WORD = "actuación"
EXPEDIENTE_WORD = "expediente"
ARTICLE_MARK = "bis"

JUDGE_LEMMAS = ["juez", "jueza", "Juez", "Jueza"]
SECRETARY_LEMMAS = [
    "secretario", "secretaria", "prosecretario", "prosecretaria", "Prosecretario",
    "Prosecretaria", "Secretario", "Secretaria",
]
PROSECUTOR_LEMMAS = ["fiscal", "fiscalía", "Fiscal", "Fiscalía"]
OMBUDS_LEMMAS = ["defensor", "defensora", "Defensora", "Defensor"]
ACCUSED_LEMMAS = [
    "acusado", "acusada", "imputado", "imputada", "infractor", "infractora", "Acusado", "Acusada",
    "Imputado", "Imputada", "Infractor", "Infractora",
]
ADVISOR_LEMMAS = ["asesor", "asesora", "Asesor", "Asesora"]
PHONE_LEMMAS = ["teléfono", "tel", "celular", "número", "numerar", "telefónico"]
PHONE_TEXTS = ["telefono", "tel", "cel"]

# Tags of the token-level and entity-level contextual rules, in run order.
TOKEN_RULE_TAGS = [
    ("NUM_CAUSA", ["judicial", "argentina"]),
    ("EDAD", ["español"]),
    ("NUM_CUIJ", ["judicial", "argentina"]),
    ("NUM_ACTUACIÓN", ["judicial", "argentina"]),
    ("NUM_EXPEDIENTE", ["judicial", "argentina"]),
    ("LOC", ["lugar"]),
]
ENTITY_RULE_TAGS = [
    ("FECHA_RESOLUCION", ["judicial"]),
    ("LEY", ["judicial", "argentina"]),
    ("PERIODO", ["español"]),
    ("JUEZX", ["judicial", "argentina"]),
    ("SECRETARIX", ["judicial", "argentina"]),
    ("FISCAL", ["judicial", "argentina"]),
    ("DEFENSORX", ["judicial", "argentina"]),
    ("NUM_IP", ["internet"]),
    ("NUM_TELÉFONO", ["argentina"]),
    ("PER", ["persona"]),
    ("DIRECCIÓN", ["español"]),
    ("PATENTE_DOMINIO", ["argentina"]),
]

# Closed list standing in for a part-of-speech model: prepositions (ADP).
PREPOSITIONS = [
    "a", "ante", "bajo", "con", "contra", "de", "del", "al", "desde", "en", "entre", "hacia",
    "hasta", "para", "por", "según", "sin", "sobre", "tras",
]
