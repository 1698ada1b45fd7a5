"""The newly written text of an email: line rules for quotations, the lines that introduce them, signatures, footers and notices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The words by which mail programs and people mark what is not newly written, by language (en de fr es pt it nl pl ru).
WROTE = r"wrote|writes|schrieb|a écrit|escribió|escribio|escreveu|ha scritto|schreef|napisał(?:a|\(a\))?|написал(?:а|\(а\))?|пишет"
ORIGINAL = (
    r"original message|forwarded message|forwarded by|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|message d['’]origine|message original|"
    r"message transféré|message transmis|mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|messaggio originale|messaggio inoltrato|"
    r"oorspronkelijk bericht|doorgestuurd bericht|wiadomość oryginalna|oryginalna wiadomość|wiadomość przekazana|исходное сообщение|пересланное сообщение|пересылаемое сообщение"
)
BEGIN_FORWARD = (
    r"begin forwarded message|anfang der weitergeleiteten (?:nachricht|e-mail)|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado|"
    r"início da mensagem (?:encaminhada|reencaminhada)|inizio messaggio inoltrato|begin doorgestuurd bericht|początek przekazywanej wiadomości|начало переадресованного сообщения|начало пересылаемого сообщения"
)
FROM_FIELD = r"from|von|de|da|van|od|от(?: кого)?"
OTHER_FIELD = (
    r"sent|date|to|cc|bcc|subject|reply-to|gesendet|datum|an|kopie|betreff|antwort an|envoyé(?: le)?|date|à|objet|enviado(?: el)?|enviada(?: em)?|fecha|para|asunto|data|assunto|"
    r"inviato|a|oggetto|verzonden|aan|onderwerp|wysłano|do|dw|temat|отправлено|дата|кому|копия|тема"
)
CLOSING = (
    r"(?:(?:many|kind|best|warm|warmest|kindest|with|all the|with kind|with best) )*(?:regards|wishes|thanks|best)|many thanks(?: and best wishes)?|best|all the best|cheers|thanks(?: (?:a lot|again|so much))?|thank you|thx|"
    r"talk soon|speak soon|see you(?: soon)?|take care|sincerely|yours(?: (?:sincerely|truly|faithfully))?|br|rgds|"
    r"(?:viele|beste|liebe|herzliche|schöne|freundliche) grüße|(?:viele|beste|liebe|schöne) gruesse|mit (?:freundlichen|besten|herzlichen|lieben) grüßen|mit freundlichem gruß|gruß|grüße|lg|vg|mfg|danke|vielen dank|besten dank|bis bald|"
    r"bien à vous|bien cordialement|cordialement|amicalement|à bientôt|bonne journée|merci(?: d['’]avance| beaucoup)?|salutations(?: distinguées)?|sincères salutations|"
    r"gracias|muchas gracias|un saludo|saludos(?: cordiales)?|atentamente|un abrazo|hasta pronto|cordialmente|"
    r"obrigad[oa]|abraços?|cumprimentos|atenciosamente|com os melhores cumprimentos|até breve|cordiali saluti|distinti saluti|grazie|saluti|a presto|met vriendelijke groet(?:en)?|groeten|"
    r"pozdrawiam(?: serdecznie)?|z poważaniem|serdecznie pozdrawiam|dziękuję|dzięki|с уважением|всего доброго|спасибо|с наилучшими пожеланиями"
)
DEVICE = (
    r"sent (?:from|via|with|using) (?:my|a|an|the|outlook|gmail|mail|yahoo|proton)\b.*|get (?:the )?\w+(?: \w+)? (?:app|for (?:ios|android))|get outlook.*|von unterwegs gesendet.*|"
    r"(?:von )?meine[mr] .{2,30} gesendet|gesendet (?:von|mit) (?:meine[mr]|der|unterwegs)\b.*|envoyé (?:de|depuis) (?:mon|ma)\b.*|enviado (?:desde|do|de|a partir do) (?:mi|meu)\b.*|inviato d(?:a|al) (?:mio )?.*|"
    r"verzonden vanaf .*|wysłan[eoy] z (?:mojego )?.*|отправлено с .*"
)
NOTICE = (
    r"\bintended (?:only|solely)\b|\bmeant only\b|\breceived (?:it|this|the) .{0,30}(?:in )?error\b|\bunsubscribe\b|\baccepts? no liability\b|\bregistered office\b|\bbefore printing\b|\bcopying or forwarding\b|"
    r"\bfalls sie nicht der\b|\birrtümlich erhalten\b|\bhandelsregister\b|\bdiffusion non autorisée\b|\bavant d['’]imprimer\b|\bantes de imprimir\b|"
    r"\b(?:confidential\w*|privileged|disclaimer|vertraulich\w*|confidentiel\w*|confidencial\w*|riservat[oaie]|vertrouwelijk\w*|poufn\w+|конфиденциальн\w*)\b(?=.*\b(?:message|e-?mail|mail|information|nachricht|mensaje|mensagem|messaggio|bericht|wiadomość|сообщение)\b|(?<=\b(?:message|e-?mail|mail|nachricht|mensaje|mensagem|messaggio|bericht|wiadomość|сообщение)\b.*))"
)

_QUOTED = re.compile(r"\s*(?:[>»›]|\p{L}{1,4}>(?:\s|$))")
_MARKS = re.compile(r"^[\s>»›]+")
_WROTE_END = re.compile(rf"(?i)(?:^|.*[\s>])(?:{WROTE})(?:/\w+)?(?:\s.*)?:\s*$", re.S)
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\b\d{1,2}\.? \p{L}{3,10}\.? \d{4}\b|\b\p{L}{3,10} \d{1,2}, \d{4}\b")
_NAMES_WROTE = re.compile(rf"(?:\p{{Lu}}[\p{{L}}.'’-]*,?\s+){{1,4}}(?:<[^<>]*>\s*)?(?i:{WROTE})\s*:\s*$")
_ADDRESS = re.compile(r"<[^<>]*(?:@|\[at\]|\(at\))[^<>]*>")
_ORIGINAL = re.compile(rf"(?i)\s*[-_=*—–]{{2,}}\s*(?:{ORIGINAL})\b.*$")
_BEGIN_FORWARD = re.compile(rf"(?i)\s*(?:{BEGIN_FORWARD})\s*:?\s*$")
_FROM = re.compile(rf"(?i)\s*\**(?:{FROM_FIELD})\**\s?:\**\s*\S")
_FIELD = re.compile(rf"(?i)\s*\**(?:{FROM_FIELD}|{OTHER_FIELD})\**\s?:\**(?:\s|$)")
_RULE = re.compile(r"\s*(?:[-_=*~#—–]\s?){3,}\s*$")
_DELIMITER = re.compile(r"\s*(?:--|—|–|__|-- ?-|\*\*|---)\s*$")
_CLOSING = re.compile(rf"(?i)\s*(?:{CLOSING})\s*[,.!]?\s*$")
_DEVICE = re.compile(rf"(?i)\s*(?:{DEVICE})\s*[.!]?\s*$")
_NOTICE = re.compile(rf"(?i){NOTICE}")
#: Thanks and wishes that open a sentence of the text as often as they close a mail.
_LIGHT = re.compile(r"(?i)\s*(?:best|cheers|thanks(?: \w+){0,2}|many thanks|thank you|thx|danke|vielen dank|besten dank|merci(?: .*)?|gracias|muchas gracias|obrigad[oa]|grazie|dziękuję|dzięki|спасибо)\s*[,.!]?\s*$")
_NAME_LINE = re.compile(r"\s*[-—–*]*\s*(?:(?:\p{Lu}[\p{L}.'’-]*|d[aeiu]|del|de la|van|von|der|den|le|la|y|e)[,\s]*){1,6}$")
_CONTACT = re.compile(r"(?i)[\w.+-]+\s?(?:@|\[at\]|\(at\))\s?[\w-]+|https?://|\bwww\.|\+\d[\d ().-]{6,}|\(?\d{2,5}\)?[ ./-]\d{2,}|^\s*(?:t|m|f|tel|phone|mobile|cell|fax|e-?mail|web)\b\s*[.:]?\s*\S")
_SENTENCE = re.compile(r"[.!?…]\s*$|[.!?…]\s+\p{Lu}")
_END_MARK = re.compile(rf"(?i)\s*[-_=*—–]{{2,}}\s*(?:end(?:e)? (?:of |der |des )?|fin (?:du |de la |del |de )?|fim da |fine del |koniec |конец )(?:.{{0,20}}\s)?(?:message|nachricht|mensaje|mensagem|messaggio|wiadomości|сообщения)\b.*$")


def _attribution(lines: list[str], i: int) -> int:
    """How many lines from ``i`` on introduce a quotation; 0 if they don't. Programs wrap such lines at about 70 characters, so up to four are read as one."""
    for n in (1, 2, 3, 4):
        part = lines[i : i + n]
        if len(part) < n or not all(x.strip() for x in part) or any(_QUOTED.match(x) for x in part):
            return 0
        text = " ".join(x.strip() for x in part)
        if _WROTE_END.match(text):
            after = next((x for x in lines[i + n :] if x.strip()), "")
            certain = _DATE.search(text) or _ADDRESS.search(text) or _NAMES_WROTE.match(text)
            if n > 1 and not (certain and (_ADDRESS.search(part[-1]) or _DATE.search(part[0]))):
                return 0
            return n if certain or _QUOTED.match(after) else 0
    return 0


def _header_block(lines: list[str], i: int) -> bool:
    """Whether a block of mail header fields with a sender begins at ``i``."""
    block = []
    while i < len(lines) and _FIELD.match(lines[i]):
        block.append(lines[i])
        i += 1
    return len(block) >= 2 and any(_FROM.match(x) for x in block) and bool(_FROM.match(block[0]) or len(block) >= 3)


def old_lines(body: str) -> list[bool]:
    """For each line of ``body`` (split at line feeds) whether it is not newly written. Blank lines are never marked."""
    lines = [x.rstrip("\r") for x in body.split("\n")]
    n = len(lines)
    old = [False] * n
    i = 0
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _QUOTED.match(line):
            old[i] = True
            i += 1
        elif k := _attribution(lines, i):
            old[i : i + k] = [True] * k
            i += k
        elif _ORIGINAL.match(line) or _BEGIN_FORWARD.match(line) or _header_block(lines, i) or (_RULE.match(line) and _header_block(lines, _next(lines, i + 1))):
            stop = _message_end(lines, i)
            old[i:stop] = [bool(x.strip()) for x in lines[i:stop]]
            i = stop
        elif _DEVICE.match(line):
            old[i] = True
            i += 1
        elif _RULE.match(line) and _NOTICE.search(_at(lines, _next(lines, i + 1))):
            old[i] = True
            i = _next(lines, i + 1)
            while i < n and lines[i].strip():  # a notice that is set off goes on to the next blank line
                old[i] = True
                i += 1
        elif _NOTICE.search(line) and _nothing_new_after(lines, i + 1):
            old[i] = True
            i += 1
        elif stop := _signature(lines, i):
            old[i:stop] = [bool(x.strip()) for x in lines[i:stop]]
            i = stop
        else:
            i += 1
    return old


def _next(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def _at(lines: list[str], i: int) -> str:
    return lines[i] if i < len(lines) else ""


def _begins_old(lines: list[str], i: int) -> bool:
    """Whether an earlier message, a quotation or a notice begins at ``i``."""
    x = lines[i]
    return bool(_QUOTED.match(x) or _ORIGINAL.match(x) or _BEGIN_FORWARD.match(x) or _NOTICE.search(x) or _DEVICE.match(x) or _RULE.match(x) or _header_block(lines, i) or _attribution(lines, i))


def _signs(line: str) -> bool:
    """Whether a line looks like part of a signature: a name, a way to reach someone, or a few words that are no sentence."""
    return bool(_NAME_LINE.match(line) or _CONTACT.search(line) or "|" in line or (len(line.split()) <= 6 and not _SENTENCE.search(line)))


def _block(lines: list[str], i: int) -> int:
    """Where the lines that follow one another from ``i`` on end: at a blank line or an earlier message."""
    while i < len(lines) and lines[i].strip() and not _QUOTED.match(lines[i]) and not _attribution(lines, i):
        i += 1
    return i


def _signature(lines: list[str], i: int) -> int:
    """Where the signature that begins at ``i`` with a closing formula or a delimiter ends; 0 if none begins there.

    A name may stand after a blank line, and a block of ways to reach the sender after a further one. Thanks before a sentence close nothing; a closing formula before a
    sentence is the whole signature.
    """
    n, delimiter = len(lines), bool(_DELIMITER.match(lines[i]))
    if not delimiter and not _CLOSING.match(lines[i]):
        return 0
    if delimiter and i + 1 == n:
        return 0
    end, first = i + 1, _next(lines, i + 1)
    if first == i + 1 and first < n and not _begins_old(lines, first):
        if not delimiter and not _signs(lines[first]) and not _DELIMITER.match(lines[first]):
            return 0 if _LIGHT.match(lines[i]) else end
        end = _block(lines, first)
    elif first < n and not _begins_old(lines, first) and not _DELIMITER.match(lines[first]):
        stop = _block(lines, first)
        if _NAME_LINE.match(lines[first]) and not (delimiter and _SENTENCE.search(lines[first])) and all(_signs(x) for x in lines[first:stop]):
            end = stop
        elif _LIGHT.match(lines[i]) and not all(_signs(x) for x in lines[first:stop]):
            return 0 if not delimiter and _text_follows(lines, first) else end
    # further blocks of nothing but ways to reach the sender
    while (nxt := _next(lines, end)) < n and nxt > end and not _begins_old(lines, nxt):
        stop = _block(lines, nxt)
        if not (all(_signs(x) for x in lines[nxt:stop]) and any(_CONTACT.search(x) for x in lines[nxt:stop])):
            break
        end = stop
    return end


def _text_follows(lines: list[str], i: int) -> bool:
    """Whether new text and a closing formula or delimiter of its own follow: then thanks before it were no end."""
    while i < len(lines) and not _begins_old(lines, i):
        if lines[i].strip() and (_DELIMITER.match(lines[i]) or (_CLOSING.match(lines[i]) and not _LIGHT.match(lines[i]))):
            return True
        i += 1
    return False


def _message_end(lines: list[str], i: int) -> int:
    """Where an unquoted earlier message that begins at ``i`` ends: after a line that says so, after its own signature if sentences follow that, or else with the mail."""
    for k in range(i + 1, len(lines)):
        if _END_MARK.match(lines[k]):
            return k + 1
    k = i + 1
    while k < len(lines):
        if (stop := _signature(lines, k)) > k:
            below = _next(lines, stop)
            if stop < below < len(lines) and (_NAME_LINE.match(lines[stop - 1]) or _CONTACT.search(lines[stop - 1])) and not _begins_old(lines, below) and _SENTENCE.search(lines[below]):
                return stop
            k = stop
        else:
            k += 1
    return len(lines)


def _nothing_new_after(lines: list[str], i: int) -> bool:
    """Whether only blank lines, quotations, notices, footers and earlier messages follow: a sentence amid the text may use a notice's words."""
    while i < len(lines):
        x = lines[i]
        if _ORIGINAL.match(x) or _BEGIN_FORWARD.match(x) or _header_block(lines, i):
            return True
        if k := _attribution(lines, i):
            i += k
        elif not x.strip() or _QUOTED.match(x) or _RULE.match(x) or _DEVICE.match(x) or _NOTICE.search(x):
            i += 1
        else:
            return False
    return True


def new_text(body: str, old: list[bool]) -> str:
    """The lines that are not marked, with runs of blank lines made one and none at either end; replies between quotations stay."""
    kept, blank = [], False
    for line, gone in zip(body.split("\n"), old):
        if gone or not line.strip():
            blank = True
        else:
            if blank and kept:
                kept.append("")
            kept.append(line.rstrip("\r"))
            blank = False
    return "\n".join(kept)


def reduce_emails(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """One row per email: page_id, new_text, old_lines (numbers, from 1, of the non-blank lines that the sender did not newly write), n_lines.

    A null body gives a null text and no old lines; an empty one an empty text. An email that is all quotation gives an empty text. Repeated ids
    stay repeated. Other columns of ``df`` are not looked at; the caller filters for emails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [old_lines(x) if x is not None else [] for x in b["body"]]
            yield pd.DataFrame(
                {
                    "page_id": b["page_id"],
                    "new_text": [new_text(x, m) if x is not None else None for x, m in zip(b["body"], marks)],
                    "old_lines": [[k + 1 for k, gone in enumerate(m) if gone] for m in marks],
                    "n_lines": [len(m) for m in marks],
                }
            )

    src = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(body_col).alias("body"))
    return src.mapInPandas(run, "page_id long, new_text string, old_lines array<int>, n_lines int")
