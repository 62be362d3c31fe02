"""Fits the trees of quarry.llm.pii on texts made by a grammar and writes pii_model.json.

python -m quarry.llm.train_pii documents.parquet [--rows N] [--texts N]. The grammar writes letters, tables, records, log lines and headers of
several languages around people, numbers and streets that it makes up, and around things that only look like them, so every span's
label is known; no label comes from stored documents. Documents (a bounded number) only tell which words texts mostly write small.
Of the texts, 70 % fit the trees, 15 % calibrate them (Platt) and choose thresholds, 15 % give the accuracy reported.
"""

from __future__ import annotations

import argparse
import json
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np

from quarry.llm.boost import Boosted
from quarry.llm.pii import _HAN_FAMILY, _KANJI_FAMILY, _LETTERS, KINDS, MODEL, Generator, calibrated

#: Documents and texts of the grammar that training reads; a word is ordinary if it occurs so often and mostly in small letters.
ROWS, TEXTS, ORDINARY = 10_000, 24_000, 3

_GIVEN = "Anna Maria John Peter Laura Michael Sophie Pierre José Carmen Lukas Hannah Emily David Fatima Ahmed Olga Ivan Priya Raj Chen Wei Yuki Kenji Ana Luis Elena Marco Giulia Lars Ingrid Piotr Zofia Aylin Mehmet Noah Liam Olivia Grace Thandi Kwame Aoife Sean Björn Chloé".split()
_FAMILY = "Smith Johnson Brown Miller Davis Wilson Taylor Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Carter Müller Schmidt Schneider Fischer Weber Meyer Wagner García Martínez López Sánchez Dubois Durand Moreau Laurent Rossi Ferrari Nowak Kowalski Ivanov Petrov Singh Patel Khan Ali Nguyen Tran Kim Park Zhang Wang Sato Tanaka O'Brien D'Angelo Jansen Bakker Andersson Nilsson Silva Santos".split()
_WORD_GIVEN = "Grace Hope Will Mark Rose May June Summer Art Bill Rich Frank Max Daisy Ivy Faith Joy Amber Crystal Hunter Chase Dean Drew Pat Sky".split()
_WORD_FAMILY = "Young King Baker Long Short Stone Wood Field Brown Green White Black Day Price Park Hill Bell Fox Wolf Rice Cook Page Read Bishop Banks Woods Rivers".split()
_RU_GIVEN, _RU_FAMILY = "Анна Мария Иван Пётр Ольга Сергей Елена Дмитрий Алексей Наталья".split(), "Иванов Петрова Смирнов Кузнецова Попов Васильева Соколов Морозова Волков Лебедева".split()
_SYLLABLES = "ba ko ri mel tan dor vi su len pra gar ho nis quel mur ya fen zo dal rek stu bran kly we os".split()
_TAILS = "n r x sen man ov ski berg ley ton ez i a o ström wick son dahl mark elli".split()
_NOUNS = "index cache queue shard report parser worker daemon session ledger panel bucket stream client editor token schema server backup invoice".split()
_THINGS = "Amber Falcon Silver Orion Copper Heron Quiet Harbor Granite Delta Crimson Maple Northern Light Blue Ridge Project Atlas Visual Studio Google Cloud Open Source Data Center Release Notes Control Panel User Guide Santa Fe New Haven Team Lead Blue Whale Night Owl".split()
_PLACES = "Springfield Lakeview Riverton Oakdale Westfield Brookhaven Lyon Sevilla Köln Utrecht Graz".split()


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, *of):
        return self.r.choice(of[0] if len(of) == 1 else of)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def invented(self) -> str:
        return ("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 3))) + self.pick(_TAILS)).capitalize()

    def noun(self) -> str:
        return self.pick(_NOUNS)

    def word(self, family: bool) -> str:
        if self.r.random() < 0.6:
            w = self.invented()
            if self.r.random() < 0.06:
                w = self.pick("D'", "O'", "L’") + w
            return w + ("-" + self.invented() if self.r.random() < 0.05 else "")
        if self.r.random() < 0.25:  # names that are ordinary words too
            return self.pick(_WORD_FAMILY if family else _WORD_GIVEN) if self.r.random() < 0.7 else self.noun().title()
        return self.pick(_FAMILY if family else _GIVEN)

    def person(self) -> str:
        r = self.r
        given, family = self.word(False), self.word(True)
        x = r.random()
        if x < 0.1:
            name = f"{given[0]}. {family}"
        elif x < 0.18:
            name = f"{given} {self.pick('ABCDEFGHJKLMRST')}. {family}"
        elif x < 0.28:
            name = f"{family}, {given}"
        elif x < 0.31:
            name = f"{family}, {given[0]}."
        elif x < 0.35:
            name = f"{self.pick(given, given, given[0] + '.')} {self.pick('van', 'von', 'de', 'de la', 'van der', 'da')} {family}"
        else:
            name = f"{given}{self.pick([' '] * 8 + ['  ', chr(160)])}{family}"
        return name.upper() if r.random() < 0.1 else name

    def thing(self) -> str:
        """Capitalised words that are no person."""
        i = self.r.randrange(0, len(_THINGS) - 1, 2)
        return self.pick(f"{_THINGS[i]} {_THINGS[i + 1]}", f"{self.invented()} {self.pick('Cloud', 'Server', 'Edition', 'Release', 'Panel', 'Index', 'Engine', 'Suite')}", f"{self.noun().title()} {self.noun().title()}", f"{self.pick('Amber', 'Copper', 'Silver', 'Quiet', 'Rapid')} {self.pick('Falcon', 'Heron', 'Otter', 'Canyon', 'Lantern', 'Comet')}", f"{self.pick('The', 'After', 'While', 'Run', 'See', 'Open')} {self.noun().title()}")

    def email(self) -> str:
        r = self.r
        user = self.pick(f"{self.invented()}.{self.invented()}", f"{self.invented()}{r.randint(1, 99)}", f"{self.invented()}_{self.invented()}", f"{self.pick('abcdef')}.{self.invented()}+{self.noun()}", self.invented()).lower()
        host = f"{self.pick('', 'mail.', 'corp.')}{self.invented()}.{self.pick('example', 'test', 'invalid', 'com', 'org', 'de', 'co.uk')}".lower()
        at = self.pick(["@"] * 6 + [" [at] ", "(at)", "[at]", " at ", "{at}", " (at) ", "&#64;"])
        if at == " at " or r.random() < 0.15:
            at = at if at != "@" else " [at] "
            host = host.replace(".", self.pick(" dot ", " [dot] ", "[dot]", "(dot)"))
        e = f"{user}{at}{host}"
        return e.upper() if r.random() < 0.06 and "@" in e else e

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = self.pick(" ", "-", ".", " ", "-", " ", "")
        cc = self.pick("1", "44", "49", "33", "34", "7", "86", "999", "420", "91")
        body = sep.join(d(self.pick(2, 3, 3, 4)) for _ in range(r.randint(2, 4)))
        return self.pick(
            f"+{cc}{sep or ' '}{body}", f"+{cc} (0){d(2)} / {d(2)} {d(2)} {d(2)}", f"00{cc} {body}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"+{cc}{d(10)}", f"{d(3)}-{d(4)} ext. {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{cc}-{d(3)}-{d(4)}-{d(3)}", f"0{d(4)}/{d(6)}", f"{d(3)}.{d(4)}.{d(4)}", f"00{cc} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}" if r.random() < 0.5 else f"1{d(2)} {d(4)} {d(4)}",
        )

    def ident(self) -> str:
        d, c = self.digits, lambda: self.pick("ABCDEFGHKLMNPRSTXYZ")
        return self.pick(f"{d(3)}-{d(2)}-{d(4)}", f"{d(6)}-{d(4)}", f"{c()}{d(8)}", f"{c()}{c()}{d(7)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(2)}.{d(3)}.{d(3)}-{d(2)}", d(9), f"{c()}{c()} {d(2)} {d(2)} {d(2)} {c()}", f"{d(8)}{c()}", f"{d(17)}X", f"{d(4)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), d(18))

    def other(self) -> str:
        """A number that is neither."""
        d = self.digits
        return self.pick(d(7), d(9), f"{d(3)}-{d(2)}-{d(4)}-{d(2)}", f"20{d(2)}.{self.pick('01', '07', '12')}.{d(2)}-{d(3)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(5)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(6)}-{d(4)}", f"{d(4)}/{d(4)}", f"{d(1)}.{d(3)}.{d(3)}", f"{d(10)}", f"{d(3)}.{d(4)}.{d(3)}", f"20{d(2)}-0{self.pick('123456789')}-1{d(1)}", f"{d(12)}")

    def address(self) -> tuple[str, str]:
        """(street part, what follows)."""
        r, w, n = self.r, self.invented, str(self.r.randint(1, 999)) + self.pick(["", "", "", "a", "b", "c"])
        town = self.pick(self.invented() + self.pick("ville", "ford", "", "haven", "burg"), self.pick(_PLACES))
        tail = self.pick("", f", {town}", f", {town}, {self.digits(5)}", f", {self.digits(5)} {town}", f", Apt {r.randint(1, 30)}{self.pick('ABC')}, {town}", f", Floor {r.randint(2, 30)}, {town}")
        kind = self.pick("Street St. Ave Avenue Lane Rd. Road Court Blvd Boulevard Drive Way Square Place Terrace Close Crescent Parkway".split())
        street = self.pick(
            f"{n} {w()}{self.pick('', 'field', 'ridge', 'brook', 'gate')} {kind}", f"{n} {self.pick('Old', 'North', 'Upper', 'West')} {w()} {kind}", f"{w()}{self.pick('', 'moor', 'gate')} {self.pick('Street', 'Court', 'Road', 'Lane')} {n}", f"{w()}{self.pick('straße', 'strasse', 'weg', 'platz', 'gasse', 'allee', 'str.')} {n}", f"{r.randint(1, 300)}{self.pick('', ' bis')}, {self.pick('rue', 'avenue', 'boulevard', 'place', 'chemin')} {self.pick('de la ', 'du ', 'des ', 'de ')}{w()}",
            f"{self.pick('Calle', 'Avenida', 'Plaza', 'Paseo', 'C/')} {self.pick('', 'de ', 'del ')}{w()}{self.pick(' ', ', ', ' n.º ')}{r.randint(1, 300)}", f"{self.pick('P.O. Box', 'PO Box', 'P. O. Box', 'Post Box', 'Postfach', 'Apartado', 'Apartado de Correos', 'Boîte postale', 'BP', 'Casilla')} {r.randint(10, 9999)}",
        )
        return (street.upper(), tail.upper()) if r.random() < 0.08 and "Box" not in street else (street, tail)

    def asian(self) -> list[tuple[str, str | None]]:
        r, han = self.r, lambda k: "".join(self.r.choices("明华丽芳伟静强磊娟涛敏艳军杰翔太郎子美恵一真由樹健", k=k))
        zh, ja = self.pick(_HAN_FAMILY) + han(r.randint(1, 2)), self.pick(_KANJI_FAMILY) + self.pick("", " ") + han(r.randint(1, 2))
        city, d = self.pick("上海市", "北京市", "广州市", "成都市", "浙江省杭州市"), self.digits
        num = [*self.pick([("电话：", self.phone(), "phone"), ("手机号是 ", self.phone(), "phone"), ("身份证号 ", self.ident(), "id_number"), ("护照 ", self.ident(), "id_number"), ("订单号 ", self.other(), None), ("错误码 ", self.other(), None)])]
        numj = [*self.pick([("電話: ", self.phone(), "phone"), ("携帯は ", self.phone(), "phone"), ("マイナンバー: ", self.ident(), "id_number"), ("旅券番号 ", self.ident(), "id_number"), ("注文番号 ", self.other(), None), ("ビルド ", self.other(), None)])]
        latin = self.person()
        return self.pick([
            [("请联系", None), (self.pick(" ", ""), None), (zh, "name"), ("先生，", None), (num[0], None), (num[1], num[2]), ("。", None)], [("姓名：", None), (zh, "name"), ("\n", None), (num[0], None), (num[1], num[2]), ("\n", None)], [("寄到", None), (f"{city}{self.pick('朝阳区', '徐汇区', '')}{self.pick('人民', '中山', '建设', '南京')}路{r.randint(1, 999)}号", "address"), ("。", None)],
            [("联系人 ", None), (latin, "name"), (" （", None), (self.email(), "email"), ("）", None)], [(num[0], None), (num[1], num[2]), (" 属于 ", None), (latin, "name"), (" 。", None)], [("模块在 3 次重试后停止写入，索引 ", None), (self.other(), None), (" 已清空。", None)],
            [("担当は", None), (ja, "name"), ("さんです。", None), (numj[0], None), (numj[1], numj[2]), ("\n", None)], [("氏名: ", None), (self.pick(ja, latin), "name"), ("\n", None), (numj[0], None), (numj[1], numj[2]), ("\n", None)], [("住所: ", None), (f"{self.pick('東京都', '大阪府', '神奈川県')}{self.pick('港区芝', '横浜市西区', '中央区銀座')}{r.randint(1, 9)}-{r.randint(1, 20)}-{r.randint(1, 30)}", "address"), ("\n", None)], [("索引の更新は毎晩行います。トレース ", None), (self.other(), None), (" を見る。", None)], [("担当は ", None), (latin, "name"), (self.pick(" です。", " ( "), None)], [(self.pick("担当: ", "連絡先 ", "作者 ", "由 "), None), (latin, "name"), (self.pick("。", "\n", " さん。"), None)], [("担当 ", None), (latin, "name"), (" ( ", None), (self.email(), "email"), (" )", None)],
        ])

    def sentence(self) -> str:
        n = self.noun
        return self.pick(f"The {n()} reads the {n()} before it stops.", f"After {self.r.randint(2, 90)} runs the {n()} still waits.", f"We moved the {n()} out of the {n()}.", f"Der {n().title()} liest den {n().title()} jede Nacht.", f"El {n()} guarda el {n()} cada noche.", f"Le {n()} attend le {n()} depuis hier.", f"Nobody noticed that the {n()} was gone.", f"A row in the {n()} locks at once, and a place to close the {n()} is missing.", f"Индекс {self.invented()} обновляется каждую ночь.")

    def parts(self) -> list[tuple[str, str | None]]:
        r, n = self.r, self.noun
        who, mail, tel, num, any_ = (self.person(), "name"), (self.email(), "email"), (self.phone(), "phone"), (self.ident(), "id_number"), (self.other(), None)
        if r.random() < 0.06:
            who = (who[0].lower(), "name")
        if r.random() < 0.04:
            who = (f"{self.pick(_RU_GIVEN)} {self.pick(_RU_FAMILY)}", "name")
        thing = (self.thing(), None)
        street, tail = self.address()
        home = (street, "address")
        t = lambda s: (s, None)
        x = r.random()
        if x < 0.12:
            return self.asian()
        right = self.pick(".", ",", ";", "\n", " on Monday.", f" about the {n()}.", " before noon.", " and the team.", " is away.", " (internal)", " (", f"; the {n()} waits.", " y lo cierra.", " und wartet.", " est parti.", ": ", " - ", "'", ", who left,", " for review.", " in the office.", " with thanks.", " lo vio.", " hat es gelesen.", f" at {self.invented()}.", "。", ", wants it soon.", " who began it.")
        end = self.pick([[t(right)]] * 6 + [[t(" <"), mail, t(">")], [t(", "), mail], [t(" ("), mail, t(")")], [t(self.pick("; su correo es ", ", mail: ", "; write to ")), mail, t(self.pick(".", ". ", ", please.", "; thanks"))], [t(", "), home, t(tail)]])
        if x < 0.3:  # people behind a word that names them
            left = self.pick(
                "Please ask ", "Reported by ", "Thanks to ", "Written by ", "cc ", "Contact ", "I spoke with ", "Talk to ", "Assigned to ", "Approved by ", "According to ", "Ask ", "The patch of ", "We hired ", "Mr. ", "Mrs. ", "Dr. ", "Ms ", "Frau ", "Herr ", "Sr. ", "Mme ", "Prof. ", "Hi ", "Dear ", "Hello ", "Hallo ", "Hola ", "Ansprechpartner ist ", "Bitte an ", "gemeldet von ", "revisado por ", "Lo revisó ", "Hablé con ", "Enviar a ", "Entregar a ", "rédigé par ", "signalé par ", "Vu par ", "Contactez ", "Freigabe durch ", "Отчёт подготовил ", "Автор: ",
                f"The {n()} of ", "the desk of ", "the phone of ", "the office of ", "A letter went to ", "We sent it to ", "It was signed for ", "It belongs to ", "It was ", "liegt bei ", "Das macht ", "reviewed by ", "tested by ", "created by ", "owned by ", "together with ", "a note from ", "the mail from ", "Signed: ", "Owner: ", "maintainer: ", "author = \"", "name=\"", "name: ", "user=", "owner=", "by ", "to ", "from ", "with ", "and ", "for ",
            )
            if r.random() < 0.22 and left[-2:] not in (". ", "s "):
                return [t(left), t(self.pick(thing[0], f"the {n()}", f"{self.pick('Der', 'Die', 'Das', 'El', 'La', 'Le', 'The', 'Every', 'Un', 'Una', 'Eine')} {self.pick(n().title(), self.invented())}", f"{n()} {n()}", f"{self.invented().lower()} {n()}", f"{self.invented().lower()} and {self.invented().lower()}")), t(right)]
            return [t(left), who, *end]
        if x < 0.36:
            return self.pick([
                [who, t(self.pick(" said", " wrote", " reported", " asked", " mentioned", " is away", " fixed", " hat", " ha", " a dit", " thinks", " signed", " will call", " joined", " left", " wants", " has", " liegt", " est", " set")), t(f" the {n()}.")], [thing, t(self.pick(" said", " is away", " hat", " zeigt", " endet", " est", " ha", " stores", " wants", " waits", " has", " shows")), t(f" the {n()}.")],
                [t(self.pick("Best,\n", "Regards,\n", "Thanks,\n", "Sincerely,\n", "-- \n", "Cheers,\n", "Grüße\n", "Saludos,\n")), who, t("\n"), *self.pick([[tel], [mail], [home, t(tail)], [tel, t("\n"), mail], [mail, t("\n"), home, t(tail)], []]), t("\n")], [t("Ask "), who, t(" ("), mail, t(") first.")], [mail, t("; "), who, t(" is out.")], [mail, t(", "), who, t(right)], [who, t(self.pick(" and ", ", ", " / "))] + [(self.person(), "name"), t(" met.")],
                [tel, t(self.pick(" is the desk of ", " belongs to ", " reaches ")), who, t(".")], [num, t(self.pick(" belongs to ", " is that of ", " 属于 ")), who, t(".")],
            ])
        if x < 0.52:  # numbers in sentences
            return self.pick([
                [t(self.pick("Call ", "call me on ", "Phone: ", "Tel. ", "my cell is ", "Ring ", "Fax ", "mobile ", "text ", "WhatsApp ", "sms to ", "dial ", "Telefon: ", "Llame al ", "Joindre le ", "Тел.: ", "reach me at ", "or ring ")), tel, t(self.pick(".", " today.", " after six.", "\n", " failed.", " please"))],
                [t(self.pick("passport ", "Passport no. ", "national ID ", "SSN ", "social security number ", "ID card ", "tax number ", "personal number ", "DNI ", "NIF: ", "Personalausweis ", "Steuernummer ", "carte d'identité ", "insurance number ", "driving licence ", "паспорт ", "the identity number is ", "nid=", "ssn: ", "passport_no=")), num, t(self.pick(".", " expired.", " on the form.", "\n", " was scanned.", ";"))],
                [t(self.pick("order ", "Order no. ", "ticket ", "trace ", "build ", "error ", "version ", "at offset ", "serial ", "invoice ", "seed=", "job ", "run ", "commit ", "request ", "issue #", "took ", "part ", "batch ", "code ", "transaction ", "the checksum of ", "port ", "bytes=", "model ", "case ", "sku ", "lot ", "revision ", "tag ")), any_, t(self.pick(".", " is lost.", " shipped.", " ms", " failed.", "\n", " bytes", ";"))], [t(f"The {n()} holds "), any_, t(self.pick(" rows.", " entries.", " bytes.", " keys."))], [t("On 2026-03-01 "), tel, t(" called.")], [tel, t(self.pick(" is my number.", " is the office line.", " rings twice.", " (mobile)"))], [t("Number "), any_, t(" again.")],
            ])
        if x < 0.64:  # addresses
            return self.pick([
                [t(self.pick("Ship it to ", "She lives at ", "Address: ", "Adresse : ", "Anschrift: ", "Dirección: ", "Deliver to ", "Send the box to ", "The office is at ", "home address ", "Lieferadresse ", "Enviar a ", "moved from ", "ship_to=", "the parcel for ", "address changed to '")), home, t(tail), t(self.pick(".", "\n", "'", " tomorrow.", ""))], [who, t(", "), home, t(tail + ".")], [who, t("\n"), home, t(tail + "\n")], [home, t(tail + " is the new place.")],
                [t(f"{r.randint(2, 60)} {self.pick('rows in a row', 'keys on their way', 'parts of the road', 'files in the drive', 'tests in place', 'steps each way')} failed.")], [t(f"Lane {r.randint(1, 9)} is full and {r.randint(2, 9)} {self.noun()}s take the long way.")], [t(f"{r.randint(2, 99)} {self.pick('WORKERS CLOSE', 'JOBS DRIVE', 'ITEMS PLACE', 'THREADS WAY')} done.")],
            ])
        if x < 0.82:  # records, tables, headers, logs
            k = self.pick("user", "contact", "author", "name", "owner", "customer", "requester")
            return self.pick([
                [t(f'{{"{k}": "'), who, t('", "email": "'), mail, t('", "phone": "'), tel, t('"}')], [t(f'{{"{k}": "'), who, t('", "id": '), any_, t("}")], [t(f"{r.randint(1, 900)},"), who, t(","), mail, t(","), tel, t(",active\n")], [t("| "), who, t(" | "), tel, t(" | "), mail, t(" |\n")], [t("| "), who, t(" | "), tel, t(f" | {n()} |\n")], [t("| "), who, t(" | "), mail, t(f" | {n()} |\n")], [t("| "), thing, t(" | "), any_, t(" | "), t(n()), t(" |\n")], [t(f"{r.randint(1, 900)},"), thing, t(","), any_, t(",open\n")],
                [t("From: "), who, t(" <"), mail, t(">\nSubject: "), thing, t("\n")], [t(self.pick("Signed-off-by: ", "Reviewed-by: ", "Co-authored-by: ")), who, t(" <"), mail, t(">\n")], [t(f"INFO login {k}="), who, t(" mail="), mail, t(f" ip=10.0.{r.randint(0, 9)}.{r.randint(1, 99)}\n")], [t(f"{k}: "), who, t("\nemail: "), mail, t("\n")], [t("# maintainer: "), who, t(" <"), mail, t(">\n")], [t('author = "'), who, t('"\n')], [t("profile name=\""), who, t('" nid='), num, t("\n")],
                [t("WARN sms to "), tel, t(f" failed after {r.randint(1, 900)} ms\n")], [t("INFO trace="), any_, t(f" took {r.randint(1, 900)}ms\n")], [t(f"2026-0{r.randint(1, 9)}-1{r.randint(0, 9)} 12:0{r.randint(0, 9)}:00 INFO {n()} "), any_, t(" ok\n")], [t("name: "), thing, t(f"\nversion: {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}\n")], [t(f"{self.invented()} {self.invented()}: "), any_, t("\n")][1:], [t("\n"), tel, t("\n")], [t(self.pick("owner=", "reporter=", "by=")), who, t(f" code={r.randint(1, 90)}\n")],
            ])
        if x < 0.94:  # things that look like persons, hosts and pins that look like mail
            return self.pick([
                [t(self.pick("The ", "See the ", "Open ", "We released ", "Run ", "In ", "About ", "From ", "project ", "codename ", "replaces ", "of the ")), thing, t(self.pick(" release.", " is out.", " replaces the old one.", " failed.", f" {n()}.", ", version 2.", " ships today."))], [t("git clone git@"), t(f"{self.invented().lower()}.example"), t(f":{n()}/{n()}.git\n")], [t(f"Pinned {n()}@{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)} and {self.invented().lower()}@latest.")], [t(f"Decorate it with @{n()} or @{n()}.{n()}.")], [t(f"https://{n()}:x@{n()}.example/{n()}")], [t("## "), thing, t("\n")], [t(f"ssh://git@{self.invented().lower()}.example:22/{n()}.git ")], [t(f"user {n()} looks at {n()} dot files.")], [t("# "), (f"{n().title()} {n().title()} {n().title()}", None), t("\n")], [thing, t(self.pick(" replaces ", " and ", " or ")), (self.thing(), None), t(".")],
            ])
        start = self.pick("", "", "user: ", "assistant: ", "Comment: ", "Notes: ", "> ", "- ", "by then, ", "for now: ", "and ", "name: ", "from: ")
        first = self.pick("The", "This", "Every", "Each", "Das", "Die", "Der", "Ein", "Eine", "El", "La", "Los", "Le", "Les", "Un", "Una", "Ask the", "Send the", "When", "Because", "Nach", "Wenn", "Si", "Falta", "Hay", "Bitte", "Please", "Before", "Both", "No", "Not")
        return self.pick([[t(start + self.sentence())], [t(f"{start}{first} {self.pick(self.noun().title(), self.invented(), self.noun())} {self.pick('waits', 'endet', 'zeigt', 'guarda', 'attend', 'is out', 'keeps')} {self.noun()} {self.pick('when', 'antes de', 'bevor', 'avant', 'while', 'every')} {self.noun()}.")]])

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = [], [], 0
        for _ in range(self.r.randint(2, 5)):
            for s, kind in [*self.parts(), (self.pick(" ", "\n", "\n\n", " " + self.sentence() + " "), None)]:
                if kind:
                    spans.append((at, at + len(s), kind))
                out.append(s)
                at += len(s)
        return "".join(out), spans


_RUNNING = re.compile(r"(?<![\w.@+'’-])[^\W\d_]{2,}(?![\w@+'’-]|\.\w)")


def small_words(texts: list[str], least: int) -> set[str]:
    """Words of running text that occur at least so often in small letters, and mostly so."""
    small, all_ = Counter(), Counter()
    for t in texts:
        words = _RUNNING.findall(t)
        all_.update(w.lower() for w in words)
        small.update(w for w in words if w.islower())
    return {w for w, n in small.items() if n >= least and n * 2 > all_[w]}


def main() -> None:
    import pyarrow.parquet as pq

    a = argparse.ArgumentParser()
    a.add_argument("documents")
    a.add_argument("--rows", type=int, default=ROWS)
    a.add_argument("--texts", type=int, default=TEXTS)
    a.add_argument("--out", default=MODEL)
    args = a.parse_args()
    stored = [t for t in pq.read_table(args.documents, columns=["text"]).slice(0, args.rows)["text"].to_pylist() if t]
    grammar = Grammar(17)
    made = [grammar.text() for _ in range(args.texts)]
    common = small_words(stored, ORDINARY) | small_words([t for t, _ in made], ORDINARY)
    names, words = Counter(), Counter()
    for t, spans in made[: len(made) // 2]:
        words.update({w.lower() for w in _LETTERS.findall(t)})
        names.update({w.lower() for s, e, k in spans if k == "name" for w in _LETTERS.findall(t[s:e])})
    pos, neg = Counter(), Counter()
    for w in words:
        for e in (w[-3:], "^" + w[:3]):
            (pos if names[w] * 2 > words[w] else neg)[e] += 1
    n_pos, n_neg = sum(pos.values()), sum(neg.values())
    endings = {e: round(float(np.log((pos[e] + 0.5) / n_pos) - np.log((neg[e] + 0.5) / n_neg)), 3) for e in set(pos) | set(neg) if pos[e] + neg[e] >= 5}
    generator = Generator(common, endings)
    rows: dict[str, list] = {k: [] for k in KINDS}
    missed, real = Counter(), Counter()
    for i, (t, spans) in enumerate(made):
        truth = {(s, e, k) for s, e, k in spans}
        starts = {(s, k) for s, _, k in spans}
        seen = set()
        for c in generator.propose(t):
            y = (c.start, c.end, c.kind) in truth or c.kind in ("phone", "id_number", "email", "address") and (c.start, c.kind) in starts
            seen.add((c.start, c.kind))
            rows[c.kind].append((i % 20, y, c.x))
        real.update(k for *_, k in spans)
        missed.update(k for s, _, k in spans if (s, k) not in seen)
    print(f"{len(stored)} documents, {len(made)} texts, {len(common)} ordinary words; never proposed: " + ", ".join(f"{k} {missed[k] / real[k]:.4f}" for k in KINDS))
    trees, thresholds, scale = {}, {}, {}
    for kind, own in rows.items():
        part = np.array([h for h, _, _ in own])
        y = np.array([v for _, v, _ in own], float)
        x = np.array([v for _, _, v in own], float)
        fit, tune, held = part < 14, (part >= 14) & (part < 17), part >= 17
        model = Boosted.fit(x[fit], y[fit], trees=70, depth=4, rate=0.15)
        p = model.score(x[tune])
        slope, shift = 1.0, 0.0
        odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        for _ in range(50):  # Platt's two parameters by Newton's method
            q = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -40, 40)))
            g = np.array([((q - y[tune]) * odds).sum() + 0.1 * (slope - 1), (q - y[tune]).sum() + 0.1 * shift])
            w = q * (1 - q)
            h = np.array([[(w * odds * odds).sum() + 0.1, (w * odds).sum()], [(w * odds).sum(), w.sum() + 0.1]])
            slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
        scale[kind] = [round(float(slope), 4), round(float(shift), 4)]
        p, yt = calibrated(p, slope, shift), y[tune] == 1
        best = max((2 * (yt & (p >= t)).sum() / max(1, yt.sum() + (p >= t).sum()), -abs(t - 0.5), t) for t in np.linspace(0.05, 0.95, 37))
        thresholds[kind] = round(float(best[2]), 3)
        trees[kind] = model.state()
        p, yh = calibrated(model.score(x[held]), slope, shift), y[held] == 1
        chosen = p >= best[2]
        spread = ((p > 0.1) & (p < 0.9)).mean()
        print(f"{kind}: {len(y)} candidates, {int(y.sum())} true; held out precision {(yh & chosen).sum() / max(1, chosen.sum()):.4f}, recall {(yh & chosen).sum() / max(1, yh.sum()):.4f}, threshold {best[2]:.2f}, scale {scale[kind]}, mean score {p.mean():.3f} for {yh.mean():.3f} true, between 0.1 and 0.9: {spread:.3f}", flush=True)
    Path(args.out).write_text(json.dumps({"trees": trees, "thresholds": thresholds, "scale": scale, "common": sorted(common), "endings": dict(sorted(endings.items()))}, ensure_ascii=False, separators=(",", ":")))


if __name__ == "__main__":
    main()
