"""Explicit schemas; nothing is inferred."""

TOKEN = "doc_id long, page int, seq int, str string, x double, y double, w double, h double"
PAY_LINE = "struct<codice:string,descrizione:string,base:double,rifQta:double,rifUnita:string,trattenuta:double,competenza:double,cDitta:boolean,rifTesto:string,costoAzienda:double>"
ACCRUAL = "struct<residuoAp:double,maturato:double,goduto:double,godutoAp:double,saldo:double,unita:string>"
#: One statement as an archive keeps it.
RECORD = (
    "id string, documento struct<tipo:string>, periodo struct<mese:int,anno:int,label:string>, azienda struct<nome:string,cf:string>, "
    "dipendente struct<nome:string,cf:string,livello:string,qualifica:string,dataAssunzione:string>, ccnl struct<cnel:string,descrizione:string>, "
    "totali struct<competenze:double,trattenute:double,arrotondamento:double,netto:double>, "
    f"voci array<{PAY_LINE}>, ratei map<string,{ACCRUAL}>, saved timestamp"
)
