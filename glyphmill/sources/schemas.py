"""Declared schemas; nothing is inferred from data."""

ENTRY = (
    "id string, name string, category string, namespace string, syntax string, overloads array<string>, description string, "
    "parameters array<struct<name:string,type:string,description:string,optional:boolean,default:string>>, returns string, remarks string, "
    "type_fields array<struct<name:string,type:string,description:string>>, type_methods array<string>, examples array<string>, see_also array<string>, "
    "deprecated boolean, url string, scraped_at string, source string, scrape_error string"
)
INDEX = "fragment string, url string, display_name string, category string, namespace string, discovered_at string"
RESPONSE_ITEM = (
    "struct<line:int,lineNumber:int,column:int,col:int,text:string,message:string,msg:string,type:string,code:string,"
    "ctx:map<string,string>,start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
)
RESPONSE = "struct<success:boolean,reason:string,errors:array<string>,result:struct<errors:array<string>>>"
