"""The schema of the workload's table, as ``convert`` reads it."""

#: 105 columns, a name and a type each.
HITS_SCHEMA = """\
WatchID,int64
JavaEnable,int16
Title,string
GoodEvent,int16
EventTime,TIMESTAMP
EventDate,DATE
CounterID,int32
ClientIP,int32
RegionID,int32
UserID,int64
CounterClass,int16
OS,int16
UserAgent,int16
URL,string
Referer,string
IsRefresh,int16
RefererCategoryID,int16
RefererRegionID,int32
URLCategoryID,int16
URLRegionID,int32
ResolutionWidth,int16
ResolutionHeight,int16
ResolutionDepth,int16
FlashMajor,int16
FlashMinor,int16
FlashMinor2,string
NetMajor,int16
NetMinor,int16
UserAgentMajor,int16
UserAgentMinor,string
CookieEnable,int16
JavascriptEnable,int16
IsMobile,int16
MobilePhone,int16
MobilePhoneModel,string
Params,string
IPNetworkID,int32
TraficSourceID,int16
SearchEngineID,int16
SearchPhrase,string
AdvEngineID,int16
IsArtifical,int16
WindowClientWidth,int16
WindowClientHeight,int16
ClientTimeZone,int16
ClientEventTime,TIMESTAMP
SilverlightVersion1,int16
SilverlightVersion2,int16
SilverlightVersion3,int32
SilverlightVersion4,int16
PageCharset,string
CodeVersion,int32
IsLink,int16
IsDownload,int16
IsNotBounce,int16
FUniqID,int64
OriginalURL,string
HID,int32
IsOldCounter,int16
IsEvent,int16
IsParameter,int16
DontCountHits,int16
WithHash,int16
HitColor,string
LocalEventTime,TIMESTAMP
Age,int16
Sex,int16
Income,int16
Interests,int16
Robotness,int16
RemoteIP,int32
WindowName,int32
OpenerName,int32
HistoryLength,int16
BrowserLanguage,string
BrowserCountry,string
SocialNetwork,string
SocialAction,string
HTTPError,int16
SendTiming,int32
DNSTiming,int32
ConnectTiming,int32
ResponseStartTiming,int32
ResponseEndTiming,int32
FetchTiming,int32
SocialSourceNetworkID,int16
SocialSourcePage,string
ParamPrice,int64
ParamOrderID,string
ParamCurrency,string
ParamCurrencyID,int16
OpenstatServiceName,string
OpenstatCampaignID,string
OpenstatAdID,string
OpenstatSourceID,string
UTMSource,string
UTMMedium,string
UTMCampaign,string
UTMContent,string
UTMTerm,string
FromTag,string
HasGCLID,int16
RefererHash,int64
URLHash,int64
CLID,int32
"""
