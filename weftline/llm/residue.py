"""Pages that show template residue, filler text, error messages or demands for scripts instead of an article.

Character n-gram models are fitted for filler and for error notices (from wordings that the patterns below make up) and for
natural prose (from all article blocks of the table at hand: counts are added up over all rows). The log-likelihood ratio
of residue to prose is averaged over sliding windows; windows above the threshold localise the residue, and a sentence is
residue if such windows cover enough of it. What stands in quotation marks is quoted, not shown, and is left out first.
Unfilled fields and bare status codes, which hold no words for a model, are settled by form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.boilerplate import PARTS

#: Characters of an n-gram, and buckets of hashed n-grams; a model is one array of that size, whatever the corpus.
GRAM, BUCKETS = 5, 1 << 17
#: N-grams of a window, the mean log ratio that marks it, and the share of a sentence that marked windows must cover. Set so
#: that wordings held out from the examples and prose about such texts lie about equally far from COVER.
WINDOW, MARK, COVER = 20, 0.35, 0.56
#: Shortest sentence (in letters) that the models judge; shorter ones are judged with the block they stand in.
LEAST = 8

# Labelled examples the residue models are fitted on. A line is a pattern of places parted by "¦", each with its
# wordings parted by "|"; sentences() takes the wordings of a pattern in turn.
ERRORS = """
The page|This page|The article|The document|The file|The address|That page|The requested URL|The requested resource|Page|The content|The link¦|you requested|you are looking for|you were looking for|you tried to open|¦could not be found|was not found|does not exist|no longer exists|has been removed|has been deleted|has moved|may have been moved or deleted|is not available|is no longer available|cannot be displayed|could not be loaded|is missing|is gone|has expired¦|on this server|here|at this address|at the moment|from this site|any more¦.
Sorry|We're sorry|We are sorry|Oops|Whoops|Uh oh|Hmm|Apologies¦, something went wrong|, an unexpected error occurred|, there was a problem with your request|, we could not process your request|, we couldn't find that page|, that didn't work|, an error has occurred|, we are having technical problems|, this doesn't look right|, we can't seem to find it|, nothing was found¦|on our end|on our servers|while loading this page|¦. Please try again later.|. Try again in a few minutes.|. Refresh the page.|. Reload and try again.|. Go back to the home page.|. Contact the administrator if the problem persists.|. Check the address for typing mistakes.|. Use the search or return to the start page.
The server|The web server|The gateway|The proxy|Our server|The remote host|The application|The upstream service|The backend¦returned an invalid response|did not respond|timed out|is overloaded|encountered an internal error|refused the connection|could not complete your request|sent an empty response|took too long to answer|is not responding|cannot be reached|received a bad reply¦|in time|from upstream|from the origin|and your request failed|. Try later¦.
Access denied|Access forbidden|Permission denied|Authentication required|Request blocked|Unauthorized|Your IP address has been blocked|You have been blocked|Your session has expired|Your request was rejected|Unusual traffic from your network¦. You do not have access to this page|. You are not authorized to view this resource|. You are not allowed to open this document|. Please log in to continue|. You lack the permission to view this directory|. The security service stopped your request|. Incident number 12|. Reference ID 8fa1|. Error code 1020¦.
Please confirm|Verify|Prove|Please show|Confirm¦that you are a human|you are not a robot|that you are a real person|you're human¦before continuing|before you continue|to proceed|to access the site¦. Complete the security check.|. Solve the captcha.|. Tick the box below.|. We are checking your browser.|. Please wait while we check your connection.|. Just a moment.|. Complete the challenge to go on.
Too many requests|Rate limit reached|Request limit exceeded|You are sending requests too quickly|You have made too many attempts|Slow down, please|Quota exceeded¦. Try again in 30 seconds|. Wait a minute before the next request|. Retry after 60 seconds|. Please wait|. Come back later¦.
The site|This site|This website|Our website|The service|This service|This server¦is under maintenance|is down for scheduled maintenance|is temporarily offline|is currently unavailable|is undergoing maintenance|is temporarily unavailable|cannot be reached right now¦. We will be back soon|. We'll be right back|. Check back later|. Thank you for your patience|. We apologise for the inconvenience¦.
400|401|403|404|405|408|410|429|500|501|502|503|504¦Bad Request|Unauthorized|Forbidden|Not Found|Method Not Allowed|Request Timeout|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Timeout¦|Error|- page not found|. Server error.|. HTTP error.
Error 404|HTTP error 500|Status 503|Error code 403|HTTP 502|Error|Fatal error|Application error|Server error|Runtime error|Critical error¦: page not found|: internal error|: service unavailable|: forbidden|: bad gateway|: unknown error|: the request could not be handled|: an exception was thrown
Fatal error|Warning|Notice|Parse error|Deprecated|Uncaught exception¦: Uncaught Error: Call to undefined function|: include(config.inc): failed to open stream: No such file or directory|: Undefined variable $page|: Undefined array key|: syntax error, unexpected end of file|: Cannot modify header information|: Argument must be of type string, null given|: Division by zero¦in /var/www/html/index.php on line 12|in /home/site/public/lib.php:48|in /app/src/main.php on line 3
TypeError|ReferenceError|ValueError|SyntaxError|RuntimeException|AttributeError|KeyError|NullPointerException|NameError¦: Cannot read properties of undefined|: x is not defined|: invalid literal|: Unexpected token in JSON|: null is not an object|: 'NoneType' object has no attribute|: undefined method for nil|: expected string, got null|: list index out of range¦at main (app.js:10:5)|File "main.py", line 7, in run|at com.example.Main.run(Main.java:42)|in module on line 3. Stack trace: #0
Unable to connect to|Could not connect to|Cannot connect to|Failed to connect to|Lost connection to|Error connecting to|No connection to|Error while opening¦the database server|the database|host localhost|server db1|MySQL server on port 3306|the cache|the remote server¦.|: connection refused.|: timeout.|: unknown host.|. Query failed.
Traceback (most recent call last)|Exception in thread main|Unhandled exception|Stack trace|Segmentation fault|Out of memory|Connection reset by peer|Internal error¦: File "run.py", line 3, in main|: java.lang.IllegalStateException|: core dumped|: see the server log
JavaScript|Scripting|JavaScript and cookies|Browser scripting|Active scripting¦must be enabled|is required|is disabled|has been turned off|needs to be on|is not supported|seems to be off¦to view this page|to use this site|in your browser|to run this application|to display the article|for this page to work|to continue¦.
Please|You must|You need to|To go on, please|To read this,¦enable|turn on|activate|allow|switch on¦JavaScript|scripts|cookies and JavaScript|scripting¦in your browser|in the browser settings|to see this content|to load the page|to read the article|and reload|and refresh the page¦.
Your browser|This browser|Your device|The browser you use¦has JavaScript disabled|blocks scripts|is out of date|is not supported|cannot show this content|does not run scripts|has scripting turned off|does not support JavaScript¦|, so the page stays empty|, so we can't show the article|. Please upgrade|. Please change the settings¦.
Loading|Loading, please wait|Loading content|The app is loading|Please wait while the page loads|Content is being loaded¦...|. If the page stays blank, allow JavaScript.|. If nothing appears, enable scripts.|. This app needs JavaScript.|. Check that scripts are not blocked.
Die Seite|Diese Seite|Der Artikel|Die aufgerufene Seite|Das Dokument|Die gesuchte Adresse|Der Inhalt¦wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|ist nicht mehr verfügbar|wurde gelöscht|wurde verschoben|kann nicht angezeigt werden|ist leider nicht erreichbar¦. Bitte prüfen Sie die Adresse|. Zurück zur Startseite|. Fehler 404|. Bitte versuchen Sie es später noch einmal|. Nicht gefunden¦.
Zugriff verweigert|Zugang gesperrt|Keine Berechtigung|Interner Serverfehler|Ein Fehler ist aufgetreten|Zu viele Anfragen|Der Dienst ist zurzeit nicht verfügbar|Wegen Wartungsarbeiten nicht erreichbar|Der Server antwortet nicht|Verbindung zur Datenbank fehlgeschlagen|Sicherheitsprüfung: sind Sie ein Mensch?¦. Bitte später erneut versuchen|. Bitte melden Sie sich an|. Wir sind gleich zurück|. Ihre Anfrage wurde blockiert¦.
JavaScript|Skripte|Bitte JavaScript|Bitte schalten Sie Skripte|Bitte aktivieren Sie Skripte|Ihr Browser unterstützt kein JavaScript|JavaScript ist deaktiviert¦im Browser einschalten|in den Einstellungen erlauben|muss aktiviert sein|wird benötigt|, um den Artikel zu lesen|, um die Seite anzuzeigen|, damit der Inhalt geladen wird¦.
La page|Cette page|L'article|Le document|La page recherchée|L'adresse demandée|Ce contenu¦est introuvable|n'a pas été trouvée|n'existe plus|n'est plus disponible|a été supprimée|a été déplacée|ne peut pas être affichée|est momentanément inaccessible¦. Vérifiez l'adresse|. Retour à l'accueil|. Erreur 404|. Veuillez réessayer|. Merci de revenir plus tard¦.
Accès refusé|Accès interdit|Erreur interne du serveur|Une erreur s'est produite|Trop de requêtes|Service indisponible|Site en maintenance|Le serveur ne répond pas|Connexion à la base de données impossible|Confirmez que vous êtes humain¦. Vous n'avez pas les droits|. Votre demande a été bloquée|. Veuillez patienter|. Nous revenons bientôt¦.
JavaScript|Les scripts|Veuillez activer JavaScript|Activez les scripts|Votre navigateur n'accepte pas JavaScript|JavaScript est désactivé¦dans votre navigateur|doit être activé|est nécessaire|pour lire l'article|pour afficher la page|pour voir ce contenu¦.
La página|Esta página|El artículo|El documento|La dirección solicitada|Este contenido¦no se ha encontrado|no existe|no está disponible|ya no está disponible|ha sido eliminada|se ha movido|no se puede mostrar|no pudo cargarse¦. Compruebe la dirección|. Volver al inicio|. Error 404|. Inténtelo más tarde|. Disculpe las molestias¦.
Acceso denegado|Acceso prohibido|Error interno del servidor|Ha ocurrido un error|Demasiadas solicitudes|Servicio no disponible|Sitio en mantenimiento|El servidor no responde|No se pudo conectar con la base de datos|Confirme que es humano¦. No tiene permiso|. Su solicitud ha sido bloqueada|. Espere un momento|. Volvemos pronto¦.
JavaScript|Los scripts|Debe activar JavaScript|Active los scripts|Habilite JavaScript|Su navegador no admite JavaScript|JavaScript está desactivado¦en su navegador|debe estar activado|es necesario|para leer el artículo|para mostrar la página|para ver este contenido¦.
Страница|Эта страница|Статья|Запрошенный адрес|Документ|Материал¦не найдена|не существует|удалена|перемещена|больше недоступна|не может быть показана|временно недоступна¦. Проверьте адрес|. Вернитесь на главную|. Ошибка 404|. Попробуйте ещё раз|. Повторите попытку позже¦.
Доступ запрещён|Доступ закрыт|Внутренняя ошибка сервера|Произошла ошибка|Слишком много запросов|Сервис недоступен|Ведутся технические работы|Сервер не отвечает|Нет соединения с базой данных|Подтвердите, что вы человек¦. У вас нет прав|. Ваш запрос заблокирован|. Подождите немного|. Мы скоро вернёмся¦.
JavaScript|Скрипты|Включите скрипты|Разрешите JavaScript|Ваш браузер не поддерживает JavaScript|JavaScript отключён¦в браузере|в настройках|должен быть включён|необходим|для просмотра страницы|чтобы прочитать статью¦.
"""
FILLER = """
Lorem ipsum dolor sit amet|consectetur adipiscing elit|sed do eiusmod tempor incididunt|ut labore et dolore magna aliqua|Ut enim ad minim veniam|quis nostrud exercitation ullamco|laboris nisi ut aliquip ex ea commodo consequat|Duis aute irure dolor in reprehenderit|in voluptate velit esse cillum dolore|eu fugiat nulla pariatur|Excepteur sint occaecat cupidatat non proident|sunt in culpa qui officia deserunt mollit anim id est laborum¦,|.¦Praesent commodo cursus magna vel scelerisque nisl|Aenean lacinia bibendum nulla sed consectetur|Vestibulum id ligula porta felis euismod semper|Donec sed odio dui nullam quis risus eget urna mollis ornare|Vitae sapien pellentesque habitant morbi tristique|Mauris pharetra augue neque gravida|Cras tincidunt lobortis feugiat vivamus|Fusce dapibus tellus ac cursus|Sed ut perspiciatis unde omnis iste natus|Integer posuere erat ante venenatis|Curabitur varius lacus vel pretium¦.
nisl|odio|risus|augue|felis|tellus|lacus|porta|magna|donec|vitae|nulla|sapien|mollis|ornare|pretium|tempor|varius|cursus¦quis|lorem|ipsum|dolor|amet|magna|felis|vitae|donec|augue|tellus|nisl|porta|lacus|risus|varius|mollis¦tempor|nulla|odio|sapien|cursus|ornare|pretium|lorem|vitae|nisl|dolor|magna|tellus¦augue|felis|porta|quis|donec|lacus|mollis|risus|varius|amet|ipsum¦
Your|Add your|Insert your|Enter your|Type your|Put your|Some|The¦text|headline|title|content|copy|story|caption|description|subtitle|name¦here|goes here|will go here|will appear here|to follow|to come|to be added|belongs here¦.
This is|Here is|Just|Only|A piece of¦a placeholder|dummy text|sample text|filler text|example content|test content|a test article|a mock article|placeholder copy|a sample page¦for the layout|for testing|for demonstration purposes|to test the design|, please replace|, please ignore|, not for publication|used to fill the page|, never publish this¦.
Replace|Delete|Remove|Overwrite|Change|Swap¦this text|this paragraph|this sentence|this sample|this copy|the text above¦with your own|with the final text|with real content|before publishing|before going live|by the real article|when the story is ready¦.
asdf|qwer|foo bar|blah|xxx|test|text|bla|zxcv¦asdf|qwerty|baz|blah blah|xxx xxx|test test|text text|bla bla|jkl¦asdf jkl|qwer zxcv|foo bar baz|blah blah|xxx|test 123|text text|dummy dummy|hjkl¦|.|, more to follow.|, copy to come.
Hier|An dieser Stelle|Dies¦steht bald Ihr Text|folgt der Text|steht ein Blindtext|kommt noch Inhalt|ist ein Platzhalter|ist nur ein Beispieltext|ist Blindtext für das Layout¦. Bitte ersetzen|. Mustertext|. Platzhaltertext|. Nicht veröffentlichen|. Überschrift einfügen¦.
Votre texte|Le texte|Votre titre|Ceci|Texte¦apparaîtra ici|à venir|est un texte provisoire|est un exemple|de remplissage|à remplacer avant publication|factice pour la mise en page¦. Insérez votre contenu|. Faux texte|. Ne pas publier|. Titre de l'article ici¦.
Su texto|El texto|Su título|Esto|Texto¦va aquí|aparecerá aquí|es un texto provisional|es solo un ejemplo|de relleno|de prueba para el diseño|pendiente de reemplazar¦. Inserte su contenido|. Texto simulado|. No publicar|. Título del artículo aquí¦.
Здесь|Тут|Это¦будет ваш текст|появится статья|просто заполнитель|образец текста|пробный текст для макета|текст-рыба¦. Заменить перед выпуском|. Не для публикации|. Вставьте заголовок|. Тестовый материал¦.
"""
#: Natural prose that is added to what is counted in the table, so that small tables are judged soundly as well.
PROSE = """
The council of the town voted on Monday to repair the bridge before the winter, and the clerk wrote down every name. She typed the letter twice.
A visitor from the valley said that the market was larger than the one he had seen in spring. The ferry was painted white and so was the station.
Three of the farmers had asked for more time, but the board wanted an answer by the end of the week. Nobody on the ballot was known to the voters.
In the evening the library stays open for students who work during the day. It was built by a family of printers who came from the coast.
Prices for bread and milk rose again last month, while wages in the harbour stayed where they were. The report of the office was read aloud.
Officials were switched to another department after a test had shown that the old rules no longer work. He answered for hours and then went home.
Der Rat der Stadt hat am Montag beschlossen, die alte Brücke noch vor dem Winter zu reparieren. Viele Gäste kamen am Abend in das neue Stadtbad.
Die Bauern wollten mehr Zeit, aber der Vorstand verlangte eine Antwort bis zum Ende der Woche. Niemand wusste genau, warum der Zug nicht hielt.
Le conseil de la ville a voté lundi pour réparer le vieux pont avant l'hiver, et le maire a remercié tous les habitants du quartier.
Les élèves de l'école voisine ont visité le musée pendant deux heures. Personne ne savait pourquoi le marché avait fermé si tôt.
El consejo de la ciudad votó el lunes para reparar el puente viejo antes del invierno, y la alcaldesa dio las gracias a los vecinos.
Los alumnos de la escuela visitaron el museo durante dos horas. Nadie sabía por qué el mercado había cerrado tan temprano aquel sábado.
Совет города решил в понедельник отремонтировать старый мост до начала зимы, и мэр поблагодарил всех жителей района за терпение.
Ученики соседней школы провели в музее два часа. Никто не знал, почему рынок закрылся так рано в тот осенний день.
"""
#: Fields that templates leave behind, by form.
FIELD = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\{%[^%]{0,80}%\}|\$\{[^{}]{0,80}\}|#\{[^{}]{0,80}\}|<%=?[^%]{0,80}%>|%%[\w.]{2,60}%%|@@[\w.]{2,60}@@|\[\[[\w. ]{2,60}\]\]|<<[\w.]{2,60}>>|"
    r"(?<![\w_])__[A-Za-z][\w.]*?[A-Za-z]__(?![\w_])|(?<![\w$])\$[A-Za-z][\w.]{1,60}\$(?![\w$])|(?<![\w{$#])\{[A-Za-z][\w.]{1,60}\}|\[(?:insert|enter|add|your)\b[^\]]{0,60}\]|"
    r"\bTODO:\s*[\w.]+|\[object Object\]|%\([a-z_]+\)s|\{\d\}"
)
_CODE = re.compile(r"^\W*(?:error\W*)?(?:4\d\d|5\d\d)\W*$", re.I)
_CODED = re.compile(r"^\W*(?:error\W*)?[45]\d\d\W+(?:[^\W\d]+\W*){1,5}$", re.I)
_QUOTED = re.compile(r"\"[^\"]{1,300}\"|“[^”]{1,300}”|„[^“”]{1,300}[“”]|«[^»]{1,300}»|‹[^›]{1,300}›|`[^`]{1,300}`|(?<!\w)'[^']{1,300}'(?!\w)|(?<!\w)‘[^’]{1,300}’(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_STOPS = np.array([ord(c) for c in ".!?…"], dtype=np.uint32)
# What a sign may begin or be, for the test of a whole batch at once: 1 a field, 2 a quotation, 3 a blank, 4 another space.
_KIND = np.zeros(0x10000, dtype=np.uint8)
_KIND[[c for c in range(0x10000) if chr(c).isspace()]] = 4
_KIND[32] = 3
_KIND[[ord(c) for c in "{}$%@[]<_"]] = 1
_KIND[[ord(c) for c in "\"“„«‹`'‘"]] = 2


def sentences(patterns: str) -> list[str]:
    """Wordings made up of patterns: those of each place in turn, shifted with every round, so that most pairs meet."""
    out = []
    for line in patterns.strip().splitlines():
        places = [p.split("|") for p in line.split("¦")]
        for i in range(2 * max(map(len, places))):
            said = " ".join(p[(i + k * (i // len(p))) % len(p)].strip() for k, p in enumerate(places))
            out.append(re.sub(r" (?=[,.:])|^ | $|(?<= ) ", "", said))
    return out


def grams(text: str, squeeze: bool = True) -> np.ndarray:
    """Bucket of every n-gram of the folded text (a number is one sign); without squeeze the text is folded already."""
    text = re.sub(r"\d+", "0", text.lower()) if squeeze else text
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    h = c[:n].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h += c[k : n + k]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def natural_counts(parts: DataFrame) -> DataFrame:
    """bucket, n: n-grams of all article blocks, added up in every task before they are shuffled.

    Blocks that the examples alone take for residue are not counted as prose, so that an error page that makes up much of a
    table doesn't pass for natural.
    """
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    shared = parts.sparkSession.sparkContext.broadcast(Models(np.zeros(BUCKETS)).ratio)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            low = re.sub(r"\d+", "0", "\0".join(t for t in b.column("text").to_pylist() if t).lower()).split("\0")
            own = grams("\n".join(low), squeeze=False)
            if len(own) == 0:
                continue
            starts = np.minimum(np.cumsum([0, *(len(t) + 1 for t in low[:-1])]), len(own) - 1)
            sizes = np.diff(np.append(starts, len(own)))
            likest = np.max([np.add.reduceat(r[own], starts) for r in shared.value], axis=0)
            held += np.bincount(own[np.repeat(likest < 0, sizes)], minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], schema=schema)

    return parts.filter("part = 'block'").select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


class Models:
    """Log-likelihood ratio per n-gram of the likeliest kind of residue to natural prose."""

    def __init__(self, natural: np.ndarray, smooth: float = 0.2):
        natural = natural + np.bincount(grams(PROSE), minlength=BUCKETS)
        prose = self._model(natural.astype(float), smooth * max(1.0, natural.sum() / 50_000))
        self.ratio = []
        for t in (FILLER, ERRORS):
            own = np.bincount(grams("\n".join(sentences(t))), minlength=BUCKETS).astype(float)
            ratio = np.clip(self._model(own, smooth) - prose, -4, 4)
            # What neither side has seen speaks against residue, however small the table whose prose was counted.
            self.ratio.append(np.where(own == 0, np.minimum(ratio, -1.0), ratio).astype(np.float32))

    @staticmethod
    def _model(counts: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((counts + smooth) / (counts.sum() + smooth * 20_000))

    def cover(self, text: str) -> float:
        """Share of the text's characters that lie in windows marked by one kind of residue."""
        t = grams(text)
        if len(t) == 0:
            return 0.0
        best = 0.0
        size = min(WINDOW, len(t))
        for ratio in self.ratio:
            sums = np.concatenate([[0.0], np.cumsum(ratio[t], dtype=float)])
            marked = (sums[size:] - sums[:-size]) / size >= MARK
            edge = np.zeros(len(t) + 1, dtype=np.int64)
            np.add.at(edge, np.flatnonzero(marked), 1)
            np.add.at(edge, np.flatnonzero(marked) + size, -1)
            best = max(best, float((np.cumsum(edge[:-1]) > 0).mean()))
        return best

    def suspects(self, texts: list[str], parts: list[str]) -> np.ndarray:
        """Which texts hold what shows() could take for residue; all windows of the batch are worked out at once.

        Never less than shows(): whatever it judges is a run of sentences, so it must hold a marked window of WINDOW or be,
        from a start to an end of sentences, one marked window itself.
        """
        joined = "\0".join(texts)
        signs = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        kind = _KIND[np.minimum(signs, len(_KIND) - 1)]

        def holding(at: np.ndarray) -> np.ndarray:
            """The texts that hold the signs at the given places."""
            return np.unique(np.searchsorted(starts, at, side="right") - 1)

        out = np.zeros(len(texts), dtype=bool)
        out[holding(np.flatnonzero(kind == 1))] = True
        out[holding(np.array([m.start() for m in re.finditer("TODO", joined)], dtype=np.int64))] = True
        for i, p in enumerate(parts):
            if p in ("headline", "rest") and (_CODE.match(texts[i]) or _CODED.match(texts[i])):
                out[i] = True
        own = [t.strip() for t in texts]
        for i in holding(np.flatnonzero(kind == 2)):
            own[i] = _QUOTED.sub(" ", texts[i]).strip()
        blank = kind >= 3
        odd = np.concatenate([holding(np.flatnonzero((kind == 4) | blank & np.roll(blank, -1))), holding(np.flatnonzero(kind == 2))])
        for i in odd:
            own[i] = " ".join(_SENTENCE.split(own[i]))
        low = re.sub(r"\d+", "0", "\0".join(own).lower()).split("\0")
        if len(low) != len(texts):
            return np.ones(len(texts), dtype=bool)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
        joined = " ".join(low)
        t = grams(joined, squeeze=False)
        if len(t) == 0:
            return out
        # Blanks before and after sentences, as places in the padded text: n-gram k begins at sign k.
        signs = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        blanks = np.flatnonzero(signs == 32)
        bounds = np.union1d(blanks[np.isin(signs[blanks - 1], _STOPS)], starts)
        for ratio in self.ratio:
            sums = np.concatenate([[0.0], np.cumsum(ratio[t], dtype=float)])
            at = [np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= (MARK - 1e-6) * WINDOW)]
            for m in range(1, WINDOW + 1):
                size = bounds[m:] - bounds[:-m] + 2 - GRAM
                if not (size < WINDOW).any():
                    break
                short = (size > 0) & (size < WINDOW)
                first, size = bounds[:-m][short], size[short]
                at.append(first[sums[first + size] - sums[first] >= (MARK - 1e-6) * size])
            hit = np.searchsorted(starts, np.concatenate(at), side="right") - 1
            out[hit] = True
        return out

    def shows(self, text: str, part: str = "block") -> bool:
        """Whether a headline, byline or block shows residue, alone or in one of its sentences."""
        if part in ("headline", "rest") and (_CODE.match(text) or _CODED.match(text) and self.cover(text) >= COVER / 2):
            return True
        own = _QUOTED.sub(" ", text).strip()
        if FIELD.search(own):
            return True
        held = ""
        for s in _SENTENCE.split(own):
            held = f"{held} {s}".strip()
            if sum(c.isalpha() for c in held) < LEAST:
                continue
            if self.cover(held) >= COVER:
                return True
            held = ""
        return bool(held) and sum(c.isalpha() for c in held) >= LEAST and self.cover(held) >= COVER


def fit(parts: DataFrame) -> Models:
    """Models whose prose side is counted over all article blocks; BUCKETS numbers come to the driver, however large the table."""
    held = np.zeros(BUCKETS, dtype=np.int64)
    counted = natural_counts(parts).toArrow()
    held[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return Models(held)


def residue_parts(parts: DataFrame, models: Models | None = None) -> DataFrame:
    """The rows of parts that show residue."""
    models = models or fit(parts)
    shared = parts.sparkSession.sparkContext.broadcast(models.ratio)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Models.__new__(Models)
        m.ratio = shared.value
        shows = lru_cache(maxsize=20_000)(m.shows)
        for b in batches:
            texts, kinds = b.column("text").to_pylist(), b.column("part").to_pylist()
            keep = [bool(s) and shows(t, p) for s, t, p in zip(m.suspects(texts, kinds), texts, kinds, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return parts.select("page_id", "no", "part", "tag", "text").mapInArrow(judge, PARTS)


def residue_pages(parts: DataFrame, models: Models | None = None) -> DataFrame:
    """page_id of every page that shows residue as headline, byline or article text, or in place of all of these."""
    return residue_parts(parts, models).select("page_id").distinct()
