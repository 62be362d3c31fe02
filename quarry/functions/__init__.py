"""Part of quarry: functions"""
