"""Fixed values. These must equal the published behaviour for results to match;
they are stated plainly here, in natural order, and used everywhere else by name.
"""

from __future__ import annotations

# --- fixed values: social placeholder tokens (user, url, hashtag, emoji wrapper) ---
USER_TOKEN = "@usuario"
URL_TOKEN = "url"
HASHTAG_TOKEN = "hashtag"
EMOJI_WRAPPER = "emoji"
SOCIAL_TOKENS = [USER_TOKEN, URL_TOKEN, HASHTAG_TOKEN, EMOJI_WRAPPER]

# --- fixed values: sequence special tokens, in id order ---
BOS, PAD, EOS, UNK, MASK = "<s>", "<pad>", "</s>", "<unk>", "<mask>"
SEQUENCE_SPECIALS = [BOS, PAD, EOS, UNK, MASK]
# ids when the specials open the vocabulary (cls = bos, sep = eos)
CLS_ID, PAD_ID, SEP_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4

# --- fixed values: lengths and thresholds ---
MIN_TOKENS = 6               # corpus filter keeps token_len >= 6
MAX_LENGTH = 128             # truncation while counting / encoding
ENCODE_BATCH = 1024          # best encode batch
MLM_PROBABILITY = 0.15       # share of positions chosen for masking
IGNORE_INDEX = -100          # label of positions not chosen
VOCAB_SIZE, MIN_FREQUENCY, LIMIT_ALPHABET, NUM_FILES = 30_000, 10, 400, 40
RUN_SEED_BASE = 2021         # run i of a benchmark uses seed 2021 + i
SPLIT_SEED_CONTEXT = 20212021
WORD_MARK = "▁"         # metaspace: marks a word start in subword pieces
CONTINUATION = "@@ "         # continuation marker removed when detokenising

# Python's \w for the letters the corpora carry: Unicode letters, digits, underscore
WORD_CHAR = "[\\p{L}\\p{N}_]"
NON_WORD_CHAR = "[^\\p{L}\\p{N}_]"

# --- fixed values: label dimensions per task (id -> name) ---
SENTIMENT_LABELS = ["neg", "neu", "pos"]
SENTIMENT_POLARITY = ["NEG", "NEU", "POS"]
EMOTION_LABELS = ["others", "joy", "sadness", "anger", "surprise", "disgust", "fear"]
HATE_LABELS = ["ok", "hateful"]
IRONY_LABELS = ["not ironic", "ironic"]
HATE_CATEGORIES = ["WOMEN", "LGBTI", "RACISM", "CLASS", "POLITICS", "DISABLED", "APPEARANCE", "CRIMINAL"]
EXTENDED_HATE_CATEGORIES = ["CALLS"] + HATE_CATEGORIES

# --- fixed values: headline metric per task, and the two-metric table ---
TASK_METRIC = {
    "context_hate": "eval_mean_f1",
    "hate": "eval_macro_f1",
    "sentiment": "eval_macro_f1",
    "emotion": "eval_macro_f1",
    "irony": "eval_macro_f1",
}
TASK_METRICS_TABLE = {
    "context_hate": ["eval_mean_f1", "eval_hate_f1"],
    "hate": ["eval_hateful_f1", "eval_macro_f1"],
    "sentiment": ["eval_macro_f1", "eval_micro_f1"],
    "emotion": ["eval_macro_f1", "eval_micro_f1"],
    "irony": ["eval_ironic_f1", "eval_macro_f1"],
}
TASK_NAMES = {"context_hate": "CONTEXTO", "hate": "ODIO", "sentiment": "SENTIMENTO", "emotion": "EMOCION", "irony": "IRONIA"}
SCORE_TASKS_FIVE = ["context_hate", "hate", "sentiment", "emotion", "irony"]
SCORE_TASKS_FOUR = ["hate", "sentiment", "emotion", "irony"]

# --- fixed values: emoji or emoji sequence (without variation selectors and skin tones) -> Spanish name; others have none ---
EMOJI_NAMES = {
    "\U0001F923": "cara revolviéndose de la risa",
    "\U0001F602": "cara llorando de risa",
    "\U0001F600": "cara sonriendo",
    "\U0001F60D": "cara sonriendo con ojos de corazón",
    "\U0001F62D": "cara llorando fuerte",
    "\U0001F621": "cara cabreada",
    "❤": "corazón rojo",
    "\U0001F44D": "pulgar hacia arriba",
    "\U0001F64F": "manos en oración",
    "\U0001F525": "fuego",
    "\U0001F603": "cara sonriendo con ojos grandes",
    "\U0001F604": "cara sonriendo con ojos sonrientes",
    "\U0001F601": "cara radiante con ojos sonrientes",
    "\U0001F605": "cara sonriendo con sudor frío",
    "\U0001F609": "cara guiñando el ojo",
    "\U0001F60A": "cara feliz con ojos sonrientes",
    "\U0001F618": "cara lanzando un beso",
    "\U0001F970": "cara sonriendo con corazones",
    "\U0001F914": "cara pensativa",
    "\U0001F644": "cara con ojos en blanco",
    "\U0001F622": "cara llorando",
    "\U0001F614": "cara desanimada",
    "\U0001F620": "cara enfadada",
    "\U0001F631": "cara gritando de miedo",
    "\U0001F60E": "cara sonriendo con gafas de sol",
    "\U0001F634": "cara durmiendo",
    "\U0001F637": "cara con mascarilla médica",
    "\U0001F480": "calavera",
    "\U0001F4A9": "caca con ojos",
    "\U0001F921": "cara de payaso",
    "\U0001F44E": "pulgar hacia abajo",
    "\U0001F44F": "manos aplaudiendo",
    "\U0001F44C": "señal de aprobación con la mano",
    "\U0001F64C": "manos levantadas celebrando",
    "\U0001F4AA": "bíceps flexionado",
    "\U0001F44B": "mano saludando",
    "✌": "mano con señal de victoria",
    "\U0001F91D": "apretón de manos",
    "\U0001F91E": "dedos cruzados",
    "\U0001F494": "corazón roto",
    "\U0001F495": "dos corazones",
    "\U0001F496": "corazón brillante",
    "\U0001F499": "corazón azul",
    "\U0001F49A": "corazón verde",
    "\U0001F49B": "corazón amarillo",
    "\U0001F49C": "corazón morado",
    "\U0001F5A4": "corazón negro",
    "✨": "chispas",
    "⭐": "estrella blanca mediana",
    "\U0001F31F": "estrella brillante",
    "☀": "sol",
    "\U0001F308": "arcoíris",
    "\U0001F389": "cañón de confeti",
    "\U0001F382": "tarta de cumpleaños",
    "\U0001F3C6": "trofeo",
    "⚽": "balón de fútbol",
    "\U0001F3B6": "notas musicales",
    "\U0001F4F7": "cámara de fotos",
    "\U0001F4B0": "bolsa de dinero",
    "\U0001F697": "coche",
    "✅": "botón de marca de verificación",
    "❌": "marca de cruz",
    "⚠": "advertencia",
    "\U0001F6A8": "luces de policía",
    "\U0001F440": "ojos",
    "\U0001F436": "cara de perro",
    "\U0001F431": "cara de gato",
    "\U0001F339": "rosa",
    "\U0001F37A": "jarra de cerveza",
    "\U0001F377": "copa de vino",
    "\U0001F9C9": "mate",
    "\U0001F926": "persona con la mano en la frente",
    "\U0001F937": "persona encogida de hombros",
    "\U0001F469\u200D\U0001F4BB": "profesional de la tecnología mujer",
    "\U0001F468\u200D\U0001F469\u200D\U0001F467": "familia: hombre, mujer, niña",
    "\U0001F3F3\u200D\U0001F308": "bandera del arcoíris",
    "❤\u200D\U0001F525": "corazón en llamas",
    "\U0001F1E6\U0001F1F7": "bandera: Argentina",
    "\U0001F1EA\U0001F1F8": "bandera: España",
    "\U0001F1F2\U0001F1FD": "bandera: México",
    "\U0001F1E8\U0001F1F1": "bandera: Chile",
    "\U0001F1E8\U0001F1F4": "bandera: Colombia",
    "\U0001F1F5\U0001F1EA": "bandera: Perú",
    "\U0001F1FA\U0001F1FE": "bandera: Uruguay",
    "\U0001F1E7\U0001F1F7": "bandera: Brasil",
    "\U0001F1FA\U0001F1F8": "bandera: Estados Unidos",
}
# --- fixed values: skin tones, light to dark ---
SKIN_TONES = {
    "\U0001F3FB": "tono de piel claro",
    "\U0001F3FC": "tono de piel claro medio",
    "\U0001F3FD": "tono de piel medio",
    "\U0001F3FE": "tono de piel oscuro medio",
    "\U0001F3FF": "tono de piel oscuro",
}
# code-point ranges treated as emoji when no name is known
EMOJI_RANGES = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
# one emoji as it is written: a flag of two letters, a keycap, or a symbol with variation selector, skin tone and
# tag letters, joined to further ones by U+200D
_EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{231A}\\x{231B}\\x{23E9}-\\x{23FA}]\\x{FE0F}?[\\x{1F3FB}-\\x{1F3FF}]?"
EMOJI_SEQUENCE = "[\\x{1F1E6}-\\x{1F1FF}]{2}|[0-9#*]\\x{FE0F}?\\x{20E3}|" + _EMOJI + "(?:[\\x{E0020}-\\x{E007E}]+\\x{E007F})?(?:\\x{200D}" + _EMOJI + ")*"

# --- fixed values: CJK ranges spaced apart by the clean-text normaliser ---
CJK_RANGES = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]"
